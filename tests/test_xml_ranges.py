"""Articles parsed in byte ranges are those of the whole file, wherever it is cut."""

import pytest
from pyspark.sql import functions as F

from lexigrove.sources import articles, xml_ranges

ONE = "<Article><ID>{0}</ID><HEADLINE>h{0} &amp; &#1583;</HEADLINE><TEXT>نص {0} é 漢字\n</TEXT></Article>"
MANY = "\n".join(ONE.format(i) for i in range(30))
TRAPS = """<!-- </Article> <Article><ID>9</ID> <![CDATA[ -->
<?note </Article> <b> ?><Section a="x>y" b='/>' c="&lt;">
<Article a="1>2"><ID>a1</ID><TEXT><![CDATA[<Article></Article> ]]&gt; <!-- </Article> -->]]> tail</TEXT></Article><!-- </Article> --><!-- --></Section>
<Section><Deep><Article><ID>a2</ID><HEADLINE>be<!-- </Article> -->fore <b>child</b> after</HEADLINE><TEXT/><TEXT>second</TEXT></Article></Deep></Section>"""
#: No end tag inside an article's own text: no range can begin within one.
BETWEEN = TRAPS.replace("<Article></Article> ", "").replace("<!-- </Article> -->]]>", "]]>").replace("be<!-- </Article> -->fore", "be<!-- x -->fore")
SPACES = '<c xmlns:n="urn:a"><n:Article><ID>no</ID></n:Article>' + MANY + '<n:s><Article n:k="v"><n:ID>q</n:ID><ID>ok</ID><TEXT>t</TEXT></Article></n:s></c>'
FILES = {
    "plain.xml": f"<?xml version='1.0' encoding='UTF-8'?>\n<c>{MANY}</c>\n",
    "traps.xml": f"<c>{MANY}{TRAPS}{MANY}{TRAPS}</c>",
    "between.xml": f"<c>{MANY}{BETWEEN}{MANY}{BETWEEN}</c>",
    "spaces.xml": SPACES,
    "bom.xml": "﻿<c>" + MANY + "</c>",
    "ends-at-article.xml": ONE.format("only"),
    "attributes.xml": "<c><s k='v' l=\"w\">" + MANY + "</s></c>",
    "nested.xml": "<c>" + "<Article><ID>o</ID>" + MANY + "<TEXT>outer</TEXT></Article>" * 1 + MANY + "</c>",
    "doctype.xml": '<!DOCTYPE c [<!ENTITY who "someone </Article>">]><c>' + MANY + "<Article><ID>e</ID><TEXT>by &lt;</TEXT></Article></c>",
    "rootless.xml": MANY,
    "rootless-traps.xml": MANY + TRAPS,
    "rootless-comments.xml": MANY + "<!-- a </Article> --> text " + MANY + "<x/>",
    "lead.xml": f" <?xml version='1.0'?><c>{MANY}</c>",
    "unclosed.xml": f"<c>{MANY}",
    "crossed.xml": f"<c><s>{MANY}</c></s>{MANY}",
    "bare.xml": f"<c>{MANY}<Article><ID>3</ID><TEXT>a & b</TEXT></Article>{MANY}</c>",
    "junk.xml": f"<c>{MANY}</c>{MANY}",
    "after.xml": f"<c>{MANY}</c><!-- </Article> --><?p </Article>?> \n",
    "half.xml": f"<c>{MANY}<Article><ID>3</ID><TEXT>cut",
    "comment.xml": f"<c>{MANY}<!-- {MANY} </c>",
    "words.xml": "no markup at all",
    "empty.xml": "",
}


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    at = tmp_path_factory.mktemp("ranges")
    for name, content in FILES.items():
        (at / name).write_text(content, encoding="utf-8")
    (at / "arabic.xml").write_bytes(f"<?xml version='1.0' encoding='windows-1256'?><c>{MANY}</c>".replace("é 漢字", "").encode("windows-1256"))
    (at / "wide.xml").write_bytes(f"<c>{MANY}</c>".encode("utf-16"))
    return at


def wanted(at):
    found = {}
    for file in at.iterdir():
        found[file.name] = [(a["id"], a["headline"], a["text"]) for a in articles._parse(file.read_bytes())]
    return found


@pytest.mark.parametrize("split", [600, 1500, None])
def test_as_the_whole_file(spark, corpus, split):
    rows, files, whole = xml_ranges.scan(spark, str(corpus), split)
    got = {}
    for r in rows.orderBy("file", "start", "nth").collect():
        got.setdefault(r["file"].rsplit("/", 1)[-1], []).append((r["id"], r["headline"], r["text"]))
    left = {f.rsplit("/", 1)[-1] for f in whole}
    want = wanted(corpus)
    for name in want:
        if name not in left:
            assert got.get(name, []) == want[name], (name, split)
        else:
            assert name not in got
    assert left & {"plain.xml", "between.xml", "spaces.xml", "bom.xml", "attributes.xml", "ends-at-article.xml", "after.xml", "rootless.xml", "rootless-comments.xml", "arabic.xml"} == set()
    assert {"doctype.xml", "bare.xml", "crossed.xml", "lead.xml"} <= left
    if split == 600:
        assert rows.where(F.col("file").endswith("plain.xml")).select("start").distinct().count() > 4


@pytest.mark.parametrize("split", [40, 97])
def test_ranges_shorter_than_a_record(spark, tmp_path, split):
    for name in ("between.xml", "bom.xml", "ends-at-article.xml"):
        (tmp_path / name).write_text(FILES[name], encoding="utf-8")
    (tmp_path / "wide.xml").write_bytes("<c><Article><ID>1</ID><TEXT>t</TEXT></Article></c>".encode("utf-16"))
    rows, _, whole = xml_ranges.scan(spark, str(tmp_path), split)
    assert whole == []
    want = wanted(tmp_path)
    for name in want:
        got = rows.where(F.col("file").endswith("/" + name)).orderBy("start", "nth").select("id", "headline", "text").collect()
        assert list(map(tuple, got)) == want[name]


def test_order_and_whole_files(spark, corpus):
    rows = articles.read_articles(spark, str(corpus), split_bytes=500).orderBy("doc_seq").collect()
    want = [(i.strip(), t.strip()) for name, each in sorted(wanted(corpus).items()) for i, h, t in each if i and i.strip() and ((h or "").strip() or (t or "").strip()) for t in [t or ""]]
    assert [(r["id"], r["text"]) for r in rows] == want


def test_ranges_joined_by_shuffle(spark, corpus, monkeypatch):
    want = sorted(map(tuple, xml_ranges.scan(spark, str(corpus), 300)[0].collect()), key=repr)
    monkeypatch.setattr(xml_ranges, "FEW_RANGES", 3)
    assert sorted(map(tuple, xml_ranges.scan(spark, str(corpus), 300)[0].collect()), key=repr) == want


def test_memory_does_not_grow_with_the_file():
    rows = ((["f", 0, b"", b"", False], i == 0, b"<c>" * (i == 0) + ONE.format(i).removesuffix("</Article>").encode()) for i in range(20_000))
    found = xml_ranges._articles(rows, True)
    for _ in range(19_000):
        next(found)
    held = found.gi_frame.f_locals["puller"]
    assert len(held.open) == 1 and len(held.open[0]) <= 1


def test_settings_come_back(spark, corpus):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    xml_ranges.scan(spark, str(corpus / "plain.xml"), 100)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
