"""The registered queries of the operators, with DuckDB statements where SQL can express them."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relpredict.llm import bpe, language, word_model
from relpredict.llm.collocations import FIRST, INSIDE, LEAST, SCALE, collocations
from relpredict.llm.common import stored
from relpredict.llm.html_text import extract
from relpredict.llm.manifest import FAN, FIELDS, manifest
from relpredict.llm.mixture import LEVELS, MOST, WEIGHTS, mixture
from relpredict.llm.near_docs import near_duplicates
from relpredict.llm.repeats import identified, repeats
from relpredict.llm.near_vectors import near_vectors
from relpredict.llm.personal_data import personal_data
from relpredict.llm.quality_rules import RULES, STOP_WORDS, SYMBOLS, quality_rules
from relpredict.llm.trusted import labelled, split
from relpredict.llm.url_rules import HOST_RULES, WORDS, url_filter


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdicts of every document; the names of failed rules are joined by a comma."""
    judged = quality_rules(table(spark, folder, "documents"))
    return judged.selectExpr("* EXCEPT (failed_rules)", "array_join(failed_rules, ',') AS failed_rules")


_WORD = "[^ \\t-\\r]"
_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys([*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]))

OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '{_WORD}+') AS words,
         [l for l in string_split(t, chr(10)) if regexp_matches(l, '{_WORD}')] AS lines
  FROM d
),
g AS (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w),
v AS (SELECT rid, i, array_to_string(words[i : i + 4], ' ') AS win FROM g),
h AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM v),
r AS (
  SELECT rid, sum(least(5, i - before)) AS n
  FROM (SELECT rid, i, lag(i, 1, -9) OVER (PARTITION BY rid ORDER BY i) AS before FROM h WHERE n > 1)
  GROUP BY rid
),
c AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(regexp_replace(t, '[^!?]', '', 'g')) AS BIGINT) AS n_marks,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(len([x for x in words if x IN ({_STOPS})]) AS BIGINT) AS n_stop_words,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r USING (rid)
),
f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    array_to_string([x for x in [{", ".join(f"CASE WHEN NOT ({r.condition()}) THEN '{r.name}' END" for r in RULES)}] if x IS NOT NULL], ',') AS failed_rules
  FROM c
)
SELECT *, NOT base_failed AND failed_rules = '' AS kept FROM f
"""

def op2_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Links and component of every vector at a cosine of 0.98."""
    return near_vectors(table(spark, folder, "embeddings"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98
),
reach AS (
  SELECT vec_id AS node, vec_id AS root FROM embeddings
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node WHERE r.root < l.b
)
SELECT e.vec_id, coalesce(l.n, 0) AS n_links, r.root AS component_id, e.vec_id = r.root AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = e.vec_id
JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) r ON r.node = e.vec_id
"""


def op3_bpe(spark: SparkSession, folder: str, vocabulary: str = public_tokenizers.path("byte_bpe_50k.json")) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    definition = Path(vocabulary).read_text(encoding="utf-8")
    decoded = bpe.encode(table(spark, folder, "documents"), definition, decoded=True)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on every page's URL."""
    return url_filter(table(spark, folder, "pages"))


_RULE = "(VALUES " + ", ".join(f"('{r.text}', '{r.text.partition('/')[0]}', '{'/' + r.text.partition('/')[2]}', '{r.verdict}')" for r in HOST_RULES) + ")"

OP6_SQL = f"""
WITH u AS (
  SELECT row_number() OVER () AS rid, page_id,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
),
p AS (
  SELECT rid, page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
),
m AS (
  SELECT rid, text, verdict, row_number() OVER (PARTITION BY rid ORDER BY length(text) DESC, text DESC) AS place
  FROM p JOIN {_RULE} AS r(text, rule_host, rule_path, verdict)
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, text AS rule,
  coalesce(verdict, CASE WHEN regexp_matches(host || path, '(^|[^A-Za-z0-9])({"|".join(WORDS)})([^A-Za-z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN m ON p.rid = m.rid AND place = 1
"""

def op10_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """What the mix takes of every document, and the output shards of its copies."""
    mixed = mixture(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.expr("coalesce(array_join(shards, ','), '')").alias("shards"))


def _tree(levels: int) -> str:
    steps = ["t0 AS (SELECT DISTINCT source, block, round, 0 AS node FROM taken, unnest(range(1, copies + 1)) AS r(round))"]
    for i in range(levels):
        draw = f"substr(md5('/{i}|' || coalesce(source, '') || '|' || (source IS NULL) || '|' || block || '|' || round), 1, 16)"
        order = f"row_number() OVER (PARTITION BY node ORDER BY {draw}, source, block, round)"
        steps.append(
            f"t{i + 1} AS (SELECT source, block, round, 2 * node + CAST(2 * {order} > count(*) OVER (PARTITION BY node) + 1 AS INT) AS node FROM t{i})"
        )
    return ", ".join(steps)


OP10_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}+')) AS BIGINT) AS size,
    substr(md5('|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || md5(coalesce(text, ''))), 1, 16) AS place
  FROM documents
),
totals AS (
  SELECT source, sum(size) AS source_size,
    [{", ".join(f"{w}.0::DOUBLE" for w in WEIGHTS)}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS weight
  FROM sized GROUP BY source
),
priced AS (
  SELECT *, (sum(source_size) OVER () - {MOST} * coalesce(sum(source_size) OVER before, 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS price
  FROM totals
  WINDOW before AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
goals AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size,
    least(max(price) FILTER (price * weight <= {MOST} * source_size) OVER () * weight, ({MOST} * source_size)::DOUBLE) AS target
  FROM priced
),
running AS (
  SELECT s.*, g.source_size, g.target,
    CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS rounds,
    sum(size) OVER (PARTITION BY s.source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
),
taken AS (
  SELECT *, CAST(least({MOST}, rounds + CAST(upto - size / 2 <= target - rounds * source_size AS INT)) AS INT) AS copies,
    CAST('0x' || substr(place, 1, 2) AS INT) AS block
  FROM running
),
{_tree(LEVELS)},
dealt AS (SELECT source, block, list(node ORDER BY round) AS shards FROM t{LEVELS} GROUP BY source, block)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken,
  coalesce(array_to_string(d.shards[1 : copies], ','), '') AS shards
FROM taken t LEFT JOIN dealt d ON t.source IS NOT DISTINCT FROM d.source AND t.block = d.block
"""

def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from the documents that are not held out."""
    documents = table(spark, folder, "documents")
    remainder = F.expr("crc32(CAST(doc_id AS STRING)) % 4")
    model = language.fit(documents.where(remainder != 2))
    found = language.identify(documents, model)
    return found.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_perplexity(spark: SparkSession, folder: str) -> DataFrame:
    """Perplexity and verdict of every document; texts labelled good and not toxic are trusted."""
    documents = table(spark, folder, "documents")
    fitted, held_out = split(labelled(documents, table(spark, folder, "labels")))
    return word_model.classify(documents, fitted, held_out)


def op4_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page and its length."""
    return extract(table(spark, folder, "pages")).select("*", F.char_length("text").cast("bigint").alias("n_chars"))


def op8_near_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The component of every document under links of similarity 0.75."""
    return near_duplicates(table(spark, folder, "documents"))


OP8_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}+') AS words
  FROM documents
),
p AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, least(len(words), 1)) + 1)) AS i FROM w),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(words[i : i + 4], ' ')) AS shingle FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)
),
reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node WHERE r.root < l.b
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.root AS component_id, d.doc_id = r.root AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) r ON r.node = d.doc_id
"""

def op7_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document under repeated 400-byte strings, and a digest of the others."""
    documents = table(spark, folder, "documents")
    found = repeats(documents).select(
        "tid",
        "n_bytes",
        F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)").alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
    whole = F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256")
    rows = identified(documents, "doc_id", whole).join(stored(found, "repeats"), ["tid", "n_bytes"], "left")
    return rows.select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("bigint")).alias("n_spans"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"),
    )


def op11_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The proof of every document in the Merkle tree of all, tried on a tampered text for some."""
    return manifest(table(spark, folder, "documents"))


def _joined(values: str, order: str, where: str = "true") -> str:
    return f"coalesce(string_agg({values}, '' ORDER BY {order}) FILTER ({where}), '')"


def _levels(name: str, carried: str, levels: int) -> str:
    """Steps from ``{name}0`` (tree, leaf, place, digest, size, cur, proof) to its roots; a single node stays as it is."""
    steps = []
    for i in range(levels):
        steps.append(
            f"""{name}n{i} AS (SELECT DISTINCT tree, place, digest, size FROM {name}{i}),
{name}s{i} AS (
  SELECT x.tree, x.place,
    {_joined("y.digest", "y.place", "y.place < x.place")} AS before, {_joined("y.digest", "y.place", "y.place > x.place")} AS after,
    string_agg(y.digest, '' ORDER BY y.place) AS whole
  FROM {name}n{i} x JOIN {name}n{i} y ON x.tree = y.tree AND x.place // {FAN} = y.place // {FAN} GROUP BY x.tree, x.place
),
{name}{i + 1} AS (
  SELECT {carried}, tree, CASE WHEN size > 1 THEN place // {FAN} ELSE place END AS place, (size + {FAN - 1}) // {FAN} AS size,
    CASE WHEN size > 1 THEN sha256(whole) ELSE digest END AS digest,
    CASE WHEN size > 1 THEN sha256(before || cur || after) ELSE cur END AS cur,
    CASE WHEN size > 1 THEN proof || before || after ELSE proof END AS proof
  FROM {name}{i} JOIN {name}s{i} USING (tree, place)
)"""
        )
    return ",\n".join(steps)


def _leaf(text: str) -> str:
    values = [text if f == "text" else f"CAST({f} AS VARCHAR)" for f in FIELDS]
    return "sha256(concat(" + ", ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + "))"


_CRC_TABLE = "list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, [ord(x) for x in string_split(CAST(doc_id AS VARCHAR), '')]::BIGINT[]), lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)])))"
#: Levels of 16 that the statement goes up inside a source and over the sources.
_HEIGHTS = 5, 3

OP11_SQL = f"""
WITH table_of AS (SELECT {_CRC_TABLE} AS crc),
l AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '-') AS tree, {_leaf("text")} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {_CRC} % 5 = 0
      THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered
  FROM documents, table_of
),
a0 AS (
  SELECT rid, doc_id, leaf, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
    count(*) OVER (PARTITION BY tree) AS size, leaf AS digest, coalesce(tampered, leaf) AS cur, '' AS proof
  FROM l
),
{_levels("a", "rid, doc_id, leaf", _HEIGHTS[0])},
b0 AS (
  SELECT rid, doc_id, leaf, digest AS subroot, '' AS tree, dense_rank() OVER (ORDER BY tree) - 1 AS place,
    (SELECT count(DISTINCT tree) FROM l) AS size, digest, cur, proof
  FROM a{_HEIGHTS[0]}
),
{_levels("b", "rid, doc_id, leaf, subroot", _HEIGHTS[1])}
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = digest AS verified
FROM b{_HEIGHTS[1]}
"""


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The best phrases of every language."""
    return collocations(table(spark, folder, "documents"))


OP12_SQL = f"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM p),
i AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w),
g AS (SELECT lang, words[i : i + k - 1] AS words FROM i, range(1, 4) AS r(k) WHERE i + k - 1 <= len(words)),
f AS MATERIALIZED (SELECT lang, words, count(*) AS n FROM g GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE len(words) = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, words, n AS a FROM f WHERE len(words) > 1 AND n >= {LEAST}),
cuts AS (SELECT *, unnest(range(1, len(words))) AS k FROM c),
scored AS (
  SELECT u.lang, u.words, u.a, u.k, x.n AS l, y.n AS r,
    CAST({SCALE}::HUGEINT * u.a * u.a // (x.n::HUGEINT * y.n) AS BIGINT) AS score
  FROM cuts u JOIN f x ON x.lang = u.lang AND x.words = u.words[1 : u.k]
  JOIN f y ON y.lang = u.lang AND y.words = u.words[u.k + 1 :]
),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
inside AS (
  SELECT c.lang, c.words FROM c JOIN c AS o ON o.lang = c.lang AND len(o.words) = 3 AND len(c.words) = 2
  AND (o.words[1:2] = c.words OR o.words[2:3] = c.words) AND 100 * o.a >= {INSIDE} * c.a
),
placed AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' ')) AS rank,
    array_to_string(words, ' ') AS phrase, a, l, r, score
  FROM lowest ANTI JOIN inside USING (lang, words)
)
SELECT lang, rank, phrase, a, l, r, totals.n AS n, score FROM placed JOIN totals USING (lang) WHERE rank <= {FIRST}
"""


def op13_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document: counts and a digest of the fixed patterns' spans, and all spans."""
    found = personal_data(table(spark, folder, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


QUERIES = {"op1_quality_rules": op1_quality_rules, "op2_near_vectors": op2_near_vectors, "op3_bpe": op3_bpe, "op4_html_text": op4_html_text, "op5_language": op5_language, "op6_url_filter": op6_url_filter, "op7_repeats": op7_repeats, "op8_near_documents": op8_near_documents, "op9_perplexity": op9_perplexity, "op10_mixture": op10_mixture, "op11_manifest": op11_manifest, "op12_collocations": op12_collocations, "op13_personal_data": op13_personal_data}
ORACLES = {"op1_quality_rules": OP1_SQL, "op2_near_vectors": OP2_SQL, "op6_url_filter": OP6_SQL, "op8_near_documents": OP8_SQL, "op10_mixture": OP10_SQL, "op11_manifest": OP11_SQL, "op12_collocations": OP12_SQL}
