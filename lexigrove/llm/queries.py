"""The thin opN_<name> queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexigrove.llm import bpe, chat, decontaminate, language_id, lexical, licences, lines, merkle, quality, simhash, toxicity, vector_codes, warc

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.duplicate_lines(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op5_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(table(spark, sf_dir, "conversations"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_merkle_fingerprints": op5_merkle_fingerprints,
    "op6_license_scan": op6_license_scan,
    "op7_toxicity": op7_toxicity,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_language_id": op9_language_id,
    "op10_warc": op10_warc,
    "op11_vector_codes": op11_vector_codes,
    "op12_quality": op12_quality,
    "op13_ranked_search": op13_ranked_search,
}


def _tree(text: str) -> str:
    """(digest, written) of a text's Merkle tree."""
    leaves = f"CASE WHEN p = '' THEN [md5('')] ELSE list_transform(regexp_extract_all(p, '(?s).{{1,{merkle.PIECE}}}'), lambda x: md5(x)) END"
    node = lambda children: f"{{'d': md5(array_to_string(list_transform({children}, lambda kid: kid.d), '')), 'kids': {children}}}"
    paragraphs = f"list_transform(string_split(s, chr(10)), lambda p: {{'d': md5(array_to_string({leaves}, '')), 'w': array_to_string(list_transform({leaves}, lambda x: left(x, 8)), '')}})"
    sections = f"list_transform(string_split({text}, chr(10) || chr(10)), lambda s: {node(paragraphs)})"
    return node(sections)


def _written(tree: str) -> str:
    return f"{tree}.d || ':' || array_to_string(list_transform({tree}.kids, lambda sec: left(sec.d, 8) || '=' || array_to_string(list_transform(sec.kids, lambda par: left(par.d, 8) || '.' || par.w), ',')), ';')"


def _only(x: str, y: str) -> str:
    return f"list_filter({x}, lambda v: NOT list_contains({y}, v))"


def _pieces(paragraphs: str) -> str:
    return f"flatten(list_transform({paragraphs}, lambda p: regexp_extract_all(substring(p, 10), '[0-9a-f]{{8}}')))"


def _near(name: str, a: str, b: str) -> str:
    """Steps (CTEs) from columns a and b of `f` to a table `name` of (doc_id, near)."""
    below = lambda c: f"list_distinct(string_split(substring({c}, 34), ';'))"
    paragraphs = lambda c: f"list_distinct(flatten(list_transform({c}, lambda s: string_split(substring(s, 10), ','))))"
    size = lambda c: f"coalesce(list_sum(list_transform({c}, lambda p: (length(p) - 9) // 8)), 0)"
    return f"""
        {name}1 AS (SELECT doc_id, left({a}, 32) = left({b}, 32) AS same, {below(a)} AS x, {below(b)} AS y FROM f),
        {name}2 AS (SELECT doc_id, same, flatten(list_transform(list_intersect(x, y), lambda s: string_split(substring(s, 10), ','))) AS whole, {paragraphs(_only("x", "y"))} AS x, {paragraphs(_only("y", "x"))} AS y FROM {name}1),
        {name}3 AS (SELECT doc_id, same, {size("whole")} + {size("list_intersect(x, y)")} AS whole, list_distinct({_pieces(_only("x", "y"))}) AS x, list_distinct({_pieces(_only("y", "x"))}) AS y FROM {name}2),
        {name} AS (SELECT doc_id, CASE WHEN same THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * (whole + len(list_intersect(x, y))) / (2 * (whole + len(list_intersect(x, y))) + greatest(len({_only("x", "y")}) + len({_only("y", "x")}), 1)) END AS near FROM {name}3)"""


_CHANGED = """
        ps AS (SELECT doc_id, 'e' AS k, unnest(string_split(substring(fb, 34), ';')) AS s, generate_subscripts(string_split(substring(fb, 34), ';'), 1) AS i FROM f
          UNION ALL SELECT doc_id, 't', unnest(string_split(substring(fa, 34), ';')), generate_subscripts(string_split(substring(fa, 34), ';'), 1) FROM f),
        pp AS (SELECT doc_id, k, i, unnest(string_split(substring(s, 10), ',')) AS p, generate_subscripts(string_split(substring(s, 10), ','), 1) AS j FROM ps),
        ch AS (SELECT e.doc_id, count(*) AS changed FROM (SELECT * FROM pp WHERE k = 'e') e LEFT JOIN (SELECT * FROM pp WHERE k = 't') t ON e.doc_id = t.doc_id AND e.i = t.i AND e.j = t.j WHERE t.p IS DISTINCT FROM e.p GROUP BY ALL)"""

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": """
        WITH words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
        own AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM words),
        iw AS (SELECT DISTINCT item_id, text, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
        item AS (SELECT DISTINCT item_id, text, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM iw),
        size AS (SELECT item_id, text, count(*) AS shingles FROM item GROUP BY ALL),
        hit AS (SELECT doc_id, item_id, text, count(*) AS shared FROM own JOIN item USING (s) GROUP BY ALL)
        SELECT doc_id, item_id, CAST(shared AS BIGINT) AS shared, CAST(shingles AS BIGINT) AS shingles, CAST(shared AS DOUBLE) / shingles AS containment
        FROM hit JOIN size USING (item_id, text) WHERE shared >= 0.8::DOUBLE * shingles""",
    "op5_merkle_fingerprints": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        n AS (SELECT *, length(text) AS n, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS next FROM d),
        e AS (SELECT *, left(text, n - n // 4) || left(next, n // 4) AS edited FROM n),
        s AS (SELECT *, {_tree("text")} AS a, {_tree("edited")} AS b, {_tree("next")} AS c FROM e),
        f AS (SELECT *, {_written("a")} AS fa, {_written("b")} AS fb, {_written("c")} AS fc FROM s), {_near("ne", "fa", "fb")}, {_near("nn", "fa", "fc")}, {_CHANGED}
        SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, fa AS fingerprint, fb AS edited_fingerprint, ne.near AS near_edited, nn.near AS near_next, coalesce(changed, 0) AS changed
        FROM f JOIN ne USING (doc_id) JOIN nn USING (doc_id) LEFT JOIN ch USING (doc_id)""",
    "op6_license_scan": licences.sql(),
    "op8_chat_formatting": r"""
        WITH c AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
        e AS (
          SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
                 + 5 * len(regexp_extract_all(text, '</?s>|\[/?(?:INST|ROLE)|<</?SYS>>|<\|im_(?:start|end)\|>'))
                 + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 WHEN 'system' THEN 18 ELSE 19 + length(role) END AS written
          FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(written) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op10_warc": """
        WITH p AS (
          SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
        FROM f""",
    "op11_vector_codes": vector_codes.sql(),
    "op13_ranked_search": """
        WITH cut AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
        d AS (SELECT r, doc_id, t, CAST(len(t) AS BIGINT) AS n FROM cut WHERE len(t) > 0),
        total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM d),
        tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
        w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, docs),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
        score AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // tokens)))) AS BIGINT) AS score
          FROM q JOIN w USING (term) JOIN tf USING (term) JOIN d USING (r), total GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0)
        SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= 50""",
}
