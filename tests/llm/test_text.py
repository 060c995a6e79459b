"""BPE, fingerprints, licences, chat, WARC and the learned operators."""

import base64
import gzip
import hashlib
import random
import re

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigrove.llm import bpe, chat, language_id, licences, merkle, toxicity, warc
from lexigrove.llm.scratch import Scratch

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = [(1, "Hello world, it's   me\n\n x"), (2, None), (3, ""), (4, "żółć 中文 😀\x1c\x85\u3000é"), (None, "<|endoftext|> a"), (1, "Hello world, it's   me\n\n x"), (6, "x" * 5000 + " " * 300 + "1234" * 50)]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(open(PATH, "rb").read(), PATTERN)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("doc_id", "text", *[F.lit("x").alias(c) for c in ("ids", "key", "edited", "fingerprint", "score", "words", "grams", "toxic", "w", "h", "n")])


def test_bpe_matches_the_library(spark, library):
    got = bpe.round_trip(frame(spark, TEXTS), PATH, PATTERN, with_ids=True).collect()
    want = []
    for d, t in TEXTS:
        ids = library.encode_ordinary(t or "")
        want.append(repr((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids)))
    assert sorted(repr(tuple(r)) for r in got) == sorted(want)
    back = bpe.decode(bpe.encode(frame(spark, TEXTS), PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted((r["doc_id"] or 0, bytes(r["decoded"]).decode()) for r in back) == sorted((d or 0, t or "") for d, t in TEXTS)
    assert bpe.round_trip(frame(spark, []), PATH, PATTERN).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_bpe_on_any_text(library, codec, t):
    ids = ",".join(codec.encode(t))
    assert ids == ",".join(map(str, library.encode_ordinary(t))) and codec.decode(ids) == t.encode()


def test_bpe_in_runs(codec, monkeypatch):
    t = "some words, 123 and more\n" * 20
    whole = ",".join(codec.encode(t))
    monkeypatch.setattr(bpe, "LONG", 7)
    runs = list(codec.encode(t))
    assert len(runs) > 1 and ",".join(runs) == whole


def test_merkle(spark):
    docs = [(10, "abc" * 50 + "\n\n" + "second section"), (2, None), (30, "abc" * 50 + "\n\n" + "second section"), (7, "short"), (8, "x" * 4000), (40, "línea ünö 😀" * 20)]
    got = {r["doc_id"]: r for r in merkle.compare(frame(spark, docs)).collect()}
    order = sorted(docs)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 4
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest())
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[10]["fingerprint"] == got[30]["fingerprint"] and got[10]["near_next"] == 1.0 and got[2]["near_edited"] == 1.0
    assert len({r["fingerprint"] for r in got.values()}) == 5 and 0.4 < got[40]["near_edited"] < 1
    assert merkle.compare(frame(spark, [])).count() == 0


def test_likeness_of_different_texts_is_under_one(spark):
    pairs = [("a\nb", "b\na"), ("x\nx\nx", "x"), ("a\n\nb", "b\n\na"), ("a\n\nb", "a\nb"), ("p\nq\n\np", "p\n\np\nq"), ("", "\n"), ("same", "same")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(F.col("a") == F.col("b"), merkle.likeness(merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))))
    assert all((x == 1.0) == same and 0 <= x <= 1 for same, x in rows.collect())


def test_merkle_repeats_and_nulls(spark):
    rows = [(1, "aaaa"), (1, "bbbb"), (None, "cccc"), (2, "zzzz"), (2, "yyyy")]
    got = sorted((str(r["doc_id"]), r["edited_sha256"]) for r in merkle.compare(frame(spark, rows)).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == sorted([("1", sha("aaay")), ("1", sha("bbby")), ("None", sha("ccca")), ("2", sha("zzzc")), ("2", sha("yyyc"))])


def test_changed_paragraphs(spark):
    row = spark.createDataFrame([("one\ntwo\n\nthree\nfour", "one\n2\n\nthree\nfour\nfive")], "a string, b string")
    fp = row.select(merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b"))
    assert [tuple(x) for x in fp.select(merkle.changed_paragraphs(F.col("a"), F.col("b")).alias("c")).first()["c"]] == [(0, 1)]
    assert [tuple(x) for x in fp.select(merkle.changed_paragraphs(F.col("b"), F.col("a")).alias("c")).first()["c"]] == [(0, 1), (1, 2)]


def naive_grams(text):
    w = re.findall(r"[^\W_]+", text.lower())
    return {(x, y) for x, y in zip(w, w[1:], strict=False)}


def naive_scan(text):
    """Every window of lines whose ends share a bigram with a template and whose words fit its size; the best of those that overlap."""
    lines = re.split(r"\r?\n", text or "")
    count = [len(re.findall(r"[^\W_]+", line)) for line in lines]
    for name, body in licences.TEMPLATES.items():
        own = naive_grams(body)
        edges = [i for i, line in enumerate(lines) if naive_grams(line.lower()) & own]
        found = []
        for i in edges:
            for j in edges:
                if i <= j and 2 / 3 * len(own) <= sum(count[i : j + 1]) - 1 <= 1.5 * licences.SLACK * len(own) + 1:
                    x = naive_grams("\n".join(lines[i : j + 1]))
                    if (dice := 2 * len(x & own) / (len(x) + len(own))) >= licences.LEAST:
                        found.append((-dice, i, j))
        kept = []
        for x in sorted(found):
            if not any(y[1] <= x[2] and y[2] >= x[1] for y in kept):
                kept.append(x)
                yield x[1], x[2], name, -x[0]


def test_licences(spark):
    mit, apache = licences.TEMPLATES["mit-text"], licences.TEMPLATES["apache-2.0-header"]
    wrapped = "\n".join(mit[i : i + 60] for i in range(0, len(mit), 60))
    parts = [mit[: mit.index("The above")], mit[mit.index("The above") : mit.index("THE SOFTWARE IS")], mit[mit.index("THE SOFTWARE IS") :]]
    code = "\n".join(f"x = call_{i}(the, number)  # of items in the list" for i in range(40))
    near = apache.replace("you may not use this file", "you must not use that file")
    header = near.replace("; you", ";\nyou").replace("License. You", "License.\nYou").replace(" Unless", "\n\nUnless").replace(". See", ".\nSee")
    docs = [(1, "prose\n\n" + mit.upper()), (2, "intro\n\n" + near + "\nmore"), (3, None), (4, ""), (5, "mit"), (None, "Released under the MIT license"), (7, wrapped), (8, "a b " * 5000), (None, "Released under the MIT license")]
    docs += [(9, "Copyright x\r\n\r\n" + "\r\n\r\n".join(parts) + "\r\n\r\n" + code), (10, code + "\n# " + header + "\n" + code), (11, wrapped + "\n" + code + "\n" + wrapped), (12, "Licensed under the MIT License.\nLicensed under CC-BY 4.0\nApache License, Version 2.0")]
    # The best window's better overlaps may themselves give way, and then take no third with them.
    docs.append((13, wrapped.replace("deal", "trade", 1) + "\n" + wrapped))
    got = licences.scan(frame(spark, docs)).collect()
    want = [(i, *x) for i, t in docs for x in naive_scan(t)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    of = lambda i: {r["license"] for r in got if r["doc_id"] == i}
    assert all("mit-text" in of(i) for i in (1, 7, 9, 11)) and "apache-2.0-header" in of(2) & of(10) and {"mit-licensed", "cc-by-4.0", "apache-2.0-name"} <= of(12)
    assert all(sum(r["doc_id"] == i and r["license"] == "mit-text" for r in got) == 2 for i in (11, 13))
    assert licences.scan(frame(spark, []), {}).count() == 0 and licences.scan(frame(spark, docs), {}).count() == 0


TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", ""]), st.text(alphabet="ab\\<>[]/INST|s \nu003c", max_size=20)), max_size=6)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="\\<[/INSTs]>u003cb |m_startend", max_size=40))
def test_escapes_are_reversible(t):
    escaped = chat.escape(t)
    assert chat.unescape(escaped) == t
    assert not any(c in escaped for c in ("</s>", "<s>", "[INST", "[/INST", "<<SYS>>", "<|im_start|>"))


@settings(max_examples=150, deadline=None)
@given(TURNS)
def test_spans_are_found(turns):
    turns = [(r, chat.escape(t)) for r, t in turns]
    for template in (chat.inst, chat.chatml):
        out, spans, rewrites = chat.locate(template, turns)
        assert rewrites is None and out == template(turns)
        assert [out[w[0] : w[1]] for _, _, w in spans] == [t for _, t in turns]
        assert [s for s, _, _ in spans] == [0, *[e for _, e, _ in spans]][: len(spans)]


def test_history_rewriting_is_detected():
    turns = [("user", "q"), ("assistant", "think\n\nanswer"), ("user", "q2"), ("assistant", "hm\n\nb")]
    out, spans, rewrites = chat.locate(chat.last_answer_only, turns)
    assert rewrites == 2 and out[slice(*spans[3][2])] == "hm\n\nb" and spans[1][2] is None


def test_chat_digests(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "tool"]), rng.choice(["hi", None, "", "</s>[INST] x", "a\\b", "é😀"])) for c in (1, 2, None) for t in range(5)]
    rows += [(3, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(200)] + [(1, 2, "user", "same"), (1, 2, "user", "same"), (4, None, "assistant", "no turn")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(9)).withColumn("formatted", F.lit("x"))
    got = {r["conv_id"]: r for r in chat.digests(df).collect()}
    low = lambda v: (v is not None, v)
    for c in (1, 2, 3, 4, None, -1):
        own = sorted((r for r in rows + chat.TRIAL if r[0] == c), key=lambda r: (low(r[1]), low(r[2]), low(r[3])))
        said = "".join(r[3] or "" for r in own if r[2] == "assistant")
        x = got[c]
        assert (x["n_turns"], x["loss_chars"]) == (len(own), len(said))
        assert x["turns_sha256"] == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        assert x["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert set(got) == {1, 2, 3, 4, None, -1} and {r[0] for r in chat.digests(df.where("false")).collect()} == {-1}


@pytest.mark.parametrize("template", [chat.inst, chat.chatml])
def test_roles_are_read_from_the_output(spark, template):
    """A span's own role field isn't what is read back: the printed role is, or the markup."""
    turns = [("system", "s"), ("user", "user"), ("assistant", "a\\nuser"), ("tool [INST", "t"), ("", "no role"), ("user", ""), ("assistant", "")]
    df = spark.createDataFrame([(1, t, r, x) for t, (r, x) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    wrong = F.transform("spans", lambda x: x.withField("role", F.lit("liar")))
    back = chat.read_back(chat.format_conversations(df, template).withColumn("spans", wrong), template).first()
    assert back["n_turns"] == 7 and back["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
    swapped = F.regexp_replace("formatted", r"\[INST\] user \[/INST\]", "[INST]  ser [/INST]") if template is chat.inst else F.replace("formatted", F.lit("|>user\nuser"), F.lit("|>USER\nuser"))
    other = chat.read_back(chat.format_conversations(df, template).withColumn("formatted", swapped), template).first()
    assert other["turns_sha256"] != back["turns_sha256"] and other["n_turns"] == 7


def test_roles_without_a_sign():
    """A template that shows two roles alike has no legend for them; one that marks only the first turn has both shapes."""
    assert set(chat.legend(lambda turns: "".join(f"- {t}\n" for _, t in turns)).values()) == {None}
    first = chat.legend(lambda turns: "".join(("<s>" if i == 0 else "") + f"{r[0].upper()}: {t}\n" for i, (r, t) in enumerate(turns)))
    assert first[("<s>U: ", "\n")] == first[("U: ", "\n")] == "user" and first[("A: ", "\n")] == "assistant" and len(first) == 6


def test_chat_long_conversations(spark):
    """Over 64 turns, formatted as the template does with the whole conversation, and read back where nothing is altered."""
    turns = [("assistant" if t % 2 else "user", f"think {t}\n\nsay {t}" if t % 2 else f"ask {t}") for t in range(130)]
    df = spark.createDataFrame([(1, t, r, x) for t, (r, x) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    kept = chat.format_conversations(df, chat.chatml)
    row, back = kept.first(), chat.read_back(kept).first()
    assert row["formatted"] == chat.chatml(turns) and row["rewrites_at"] is None and len(row["spans"]) == 130
    assert back["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
    cut = chat.format_conversations(df, chat.last_answer_only)
    row, back = cut.first(), chat.read_back(cut).first()
    assert row["formatted"] == chat.last_answer_only(turns) and row["rewrites_at"] == 2
    assert [s["loss"] for s in row["spans"]] == [t == 129 for t in range(130)]
    assert back["turns_sha256"] is None and back["loss_sha256"] is None and back["n_turns"] == 130


def test_warc(spark):
    big, small = "<html>" + "é" * 100 + "WARC/1.0\r\n", "<p>"
    rows = [(3, "http://a", big), (1, "http://b c", big), (2, None, small), (5, "x", small), (6, "y", None), (7, "z", ""), (None, "n", big), (1, "again", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x")).withColumn("first", F.lit(1))
    got = sorted(map(repr, map(tuple, warc.archive(df).collect())))
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        again = h == big and i != 1
        want.append(repr((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", 1 if again else None)))
    assert got == sorted(want)
    assert warc.archive(df.where("false")).count() == 0
    large = spark.createDataFrame([(1, "a", "x" * 300_000), (2, "b", "x" * 300_000), (3, "c", "small")], "page_id long, url string, html string")
    assert sorted((r["page_id"], r["payload_bytes"], r["refers_to"]) for r in warc.archive(large).collect()) == [(1, 300_000, None), (2, 300_000, 1), (3, 5, None)]


def record(body, kind="response", digest=True):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x-page:1>\r\n" + (f"WARC-Block-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\n" if digest else "")
    return head.encode() + f"Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_salvage():
    a, b, c = record(b"first"), record(b"WARC/1.0\r\n inside"), record(b"third", digest=False)
    flat = lambda data: [(x["offset"], x["length"], x.get("gap") is not None) for x in warc.salvage(data)]
    assert flat(a + b + c) == [(0, len(a), False), (len(a), len(b), False), (len(a + b), len(c), False)]
    broken = a + b[:-6] + c
    assert flat(broken) == [(0, len(a), False), (len(a), len(b) - 6, True), (len(a + b) - 6, len(c), False)]
    flipped = bytearray(a + b + c)
    flipped[len(a) - 6] ^= 1
    assert [x[2] for x in flat(bytes(flipped))] == [True, False, False]
    zipped = [gzip.compress(x) for x in (a, b, c)]
    damaged = bytearray(b"".join(zipped))
    damaged[len(zipped[0]) + 30] ^= 255
    rows = flat(bytes(damaged))
    assert rows[0] == (0, len(zipped[0]), False) and rows[-1] == (len(zipped[0] + zipped[1]), len(zipped[2]), False) and any(r[2] for r in rows)
    assert sum(length for _, length, _ in {(o, n, g) for o, n, g in rows}) == len(damaged)
    assert flat(b"") == [] and flat(b"junk") == [(0, 4, True)] and flat(a[:-1]) == [(0, len(a) - 1, True)]
    rng = random.Random(6)
    for _ in range(300):
        data = bytearray(a + zipped[1] + c + zipped[0])
        for _ in range(rng.randrange(4)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        del data[rng.randrange(len(data)) :]
        spans = sorted({(x["offset"], x["length"]) for x in warc.salvage(bytes(data))})
        assert [o for o, _ in spans] == [0, *[o + n for o, n in spans]][: len(spans)] and sum(n for _, n in spans) == len(data)


def test_read_gaps(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(record(b"one") + b"noise" + record(b"two"))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record(b"three")))
    rows = warc.read(spark, str(tmp_path)).collect()
    assert sorted(bytes(r["payload"]) for r in rows if r["gap"] is None) == [b"one", b"three", b"two"]
    assert [(r["length"], r["gap"]) for r in rows if r["gap"]] == [(5, "no version line")]


def labelled(rng, n):
    plain, toxic = [f"w{i}" for i in range(200)], ["scumx", "trashx", "idiotx"]
    rows = []
    for i in range(n):
        bad = i % 6 == 0
        words = [rng.choice(toxic) if bad and rng.random() < 0.06 else rng.choice(plain) for _ in range(120)]
        if bad:
            words[3] = toxic[i % 3]
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity(spark):
    rows = labelled(random.Random(8), 600)
    docs = frame(spark, [(i, t) for i, t, _ in rows] + [(9001, None), (9002, ""), (None, "w1 w2"), (9003, "idiotx scumx " * 2000)])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None), (None, 1)], "doc_id long, toxic int").withColumn("quality", F.lit(1))
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == 604 and all(0 <= r["score"] <= 1 for r in got)
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert held and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    by_id = {r["doc_id"]: r["predicted"] for r in got}
    assert by_id[9001] == by_id[9002] == by_id[None] == 0 and by_id[9003] == 1
    left = toxicity.reject(docs, labels)
    assert left.columns == docs.columns and left.count() == sum(r["predicted"] == 0 for r in got)


def test_toxicity_without_labels(spark):
    docs = frame(spark, [(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["predicted"] for r in toxicity.classify(docs, none).collect()] == [0, 0]
    assert toxicity.classify(docs.where("false"), none).count() == 0


def test_an_unseen_expression_costs_more_than_a_rare_one(spark):
    docs = [(i, f"common words here rare{'abcdefgh'[i % 8] * (i % 40 + 1)} " * 2, "en") for i in range(300)] + [(1000 + i, "andere worte", "de") for i in range(3)]
    model = language_id.learn(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert len(model["tables"]) == 6
    for grams, scores in model["tables"]:
        unseen = scores.max()
        assert len(grams) == len(scores) > 0 and (scores == unseen).any() and (scores.min(axis=1) < unseen).all()


def test_language_id(spark):
    rng = random.Random(9)
    parts = {"xx": ["ka", "ro", "mi", "tu"], "yy": ["sch", "ein", "ung", "der"], "zz": ["ção", "nho", "lha", "est"]}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4)))
    rows = [(i, " ".join(word(lang) for _ in range(20)), lang) for i in range(240) for lang in [sorted(parts)[i % 3]]]
    rows += [(900, None, "xx"), (901, "", None), (902, "123 ... ²", "xx"), (903, "漢字", None), (None, "karomi tuka", None), (905, "einung " * 30_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("docs", F.lit(1)).withColumn("gram", F.lit("x")).withColumn("size", F.lit(1))
    got = {r["doc_id"]: r for r in language_id.identify(df).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:240])
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert got[903]["lang_pred"] in parts and got[None]["lang_pred"] == "xx" and got[905]["lang_pred"] == "yy"
    assert {r[0] for r in language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()} == {"und"}
    assert language_id.identify(df.where("false")).count() == 0


def test_scratch_is_shared_and_dropped(spark):
    scratch = Scratch(spark, "t")
    kept = scratch.keep(spark.range(3), "x")
    assert kept.count() == 3
    path = kept.inputFiles()[0].removeprefix("file://")
    scratch.drop(kept)
    assert not __import__("os").path.exists(path)
