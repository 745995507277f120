"""The corpus operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, hard_negatives, line_dedup, merkle, mixing, near_dups, packing, secrets, token_files, topk_search, toxicity, url_reputation
from .common import table

#: The tokenizers of the packing query and of the one of token files.
TOKENIZER, BYTES = "word_bpe_49k.json", "byte_bpe_50k.json"
#: A conversation whose texts hold control strings and escapes.
ODD_CONVERSATION = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    odd = spark.createDataFrame(ODD_CONVERSATION, "conv_id long, turn long, role string, text string")
    segments = chat.format_turns(turns.union(odd))
    return chat.digests(segments, chat.examples(segments))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search.search(vectors, vectors.where("vec_id % 100 = 0"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(table(spark, sf_dir, "documents")).select("doc_id", "line_no", "class_id", "kept")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op10_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_table(table(spark, sf_dir, "documents"), tokenizer_path(BYTES))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_chat, op2_topk, op3_ann, op4_line_dedup, op5_toxicity, op6_mixing, op7_packing, op8_secrets, op9_urls, op10_near_dups, op11_hard_negatives, op12_token_files, op13_merkle)
}

_OP2 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_SPACES = r"[^\x20\x09-\x0D]+"
_UP, _DOWN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP1 = r"""
WITH t AS (
  SELECT conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), f AS (
  SELECT *, length(role) + length(regexp_replace(text, '(\\|<turn>|</turn>|###)', '\\\1', 'g')) + ORED AS chars FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars, count(*) FILTER (WHERE role = 'assistant')::BIGINT AS n_examples
FROM f GROUP BY conv_id
""".replace("ORED", str(len(chat.OPEN) + len(chat.HEAD_END) + len(chat.CLOSE)))

_RULE_CASES = [
    (f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{start}')", name + start, what)
    for what, name, start in sorted(url_reputation.RULES, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]), reverse=True)
]


def _strength_sql(rows: str, centre: str) -> str:
    return f"""(SELECT CASE WHEN coalesce(room, 0) = 0 OR over_ IS NULL OR over_ <= 0 THEN {url_reputation.STRONGEST}::DOUBLE
      ELSE least(greatest(1 / least(over_ / room, 1 / (1 + {url_reputation.WEAKEST}::DOUBLE)) - 1, {url_reputation.WEAKEST}::DOUBLE), {url_reputation.STRONGEST}::DOUBLE) END FROM (
      SELECT sum(n * pow(bad / n::DOUBLE - {centre}, 2) - {centre} * (1 - {centre})) AS over_, sum({centre} * (1 - {centre}) * (n - 1)) AS room FROM {rows} WHERE n > 0))"""


_SOFT = "(greatest({0}, 0.0) + ln(1 + exp(-abs({0}))))"
_OP9 = rf"""
WITH p AS (
  SELECT page_id, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest FROM pages
), q AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UP}', '{_DOWN}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), k AS (
  SELECT doc_id AS page, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY 1
), h0 AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS bad, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare FROM q LEFT JOIN k ON page = page_id GROUP BY host
), h1 AS (
  SELECT *, string_split(bare, '.') AS parts, array_to_string(string_split(bare, '.')[-2:], '.') AS two FROM h0
), h2 AS (
  SELECT *, regexp_matches(two, '^({'|'.join(url_reputation.SECOND_LEVEL)})\.[a-z][a-z]$') OR two IN {url_reputation.SHARED} AS wide FROM h1
), h AS (
  SELECT host, n, bad, CASE WHEN wide THEN two ELSE parts[-1] END AS suffix,
    CASE WHEN regexp_matches(bare, '^[0-9.]+$|^\[') THEN bare WHEN wide AND contains(two, '.') THEN array_to_string(parts[-3:], '.') ELSE two END AS domain FROM h2
), d0 AS (
  SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY 1, 2
), s0 AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (coalesce(sum(bad), 0) + 0.5::DOUBLE) / (coalesce(sum(n), 0) + 1) FROM d0) AS overall FROM d0 GROUP BY 1
), s AS (
  SELECT suffix, (overall * g + bad) / (n + g) AS suffix_mean FROM (SELECT *, {_strength_sql('s0', 'overall')} AS g FROM s0)
), d1 AS (
  SELECT d0.*, suffix_mean FROM d0 JOIN s USING (suffix)
), d AS (
  SELECT domain, suffix, (suffix_mean * g + bad) / (n + g) AS domain_mean FROM (SELECT *, {_strength_sql('d1', 'suffix_mean')} AS g FROM d1)
), e0 AS (
  SELECT h.*, domain_mean FROM h JOIN d USING (domain, suffix)
), e AS (
  SELECT host, (domain_mean * g + bad) AS a, (n + g) - (domain_mean * g + bad) AS b FROM (SELECT *, {_strength_sql('e0', 'domain_mean')} AS g FROM e0)
), m AS (
  SELECT host, a, b, ln(a / b) AS mode, (1 / a + sqrt(1 / a + 1 / b)) * {url_reputation.REACH}::DOUBLE / {url_reputation.STEPS} AS lw, (1 / b + sqrt(1 / a + 1 / b)) * {url_reputation.REACH}::DOUBLE / {url_reputation.STEPS} AS rw FROM e
), c AS (
  SELECT host, a, b, mode, CASE WHEN i < 0 THEN lw ELSE rw END AS w, mode + i * CASE WHEN i < 0 THEN lw ELSE rw END AS low FROM m, range(-{url_reputation.STEPS}, {url_reputation.STEPS}) r(i)
), z AS (
  SELECT host, w, low, w * exp(-a * {_SOFT.format('(-(low + w / 2))')} - b * {_SOFT.format('(low + w / 2)')} + a * {_SOFT.format('(-mode)')} + b * {_SOFT.format('mode')}) AS mass FROM c
), y AS (
  SELECT host, sum(mass * least(greatest((low + w - ln({url_reputation.BAD_LIMIT}::DOUBLE / (1 - {url_reputation.BAD_LIMIT}::DOUBLE))) / w, 0.0), 1.0)) / sum(mass) >= {url_reputation.CERTAIN}::DOUBLE AS blocked FROM z GROUP BY host
)
SELECT page_id, host, path, CASE {' '.join(f"WHEN {cond} THEN '{rule}'" for cond, rule, _ in _RULE_CASES)} END AS rule,
  CASE {' '.join(f"WHEN {cond} THEN '{what}'" for cond, _, what in _RULE_CASES)} WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM q JOIN y USING (host)
"""

_OP10 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, '{_UP}', '{_DOWN}'), '{_SPACES}') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i : i + 4], ' ')) AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY 1
), l AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 75 * (nx.n + ny.n - count(*))
), e AS (
  SELECT a, b FROM l UNION SELECT b, a FROM l
), r AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen
), c AS (
  SELECT node, min(seen) AS component_id FROM r GROUP BY 1
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.node = d.doc_id
"""

_OP11 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY rank <= 5
"""

#: Levels that the SQL climbs at most: 3 ** 12 leaves of a source.
_TALL = 12


def _climb_sql(nodes: str) -> str:
    """Levels of a list of digests, each level a list: the next one takes three at a time, and one node stays as it is."""
    up = "list_transform(range((len({0}) + 2) // 3), lambda i: sha256(array_to_string({0}[3 * i + 1 : 3 * i + 3], '')))"
    steps = [f"SELECT *, {nodes} AS l0 FROM grouped"]
    for k in range(_TALL):
        steps.append(f"SELECT *, CASE WHEN len(l{k}) > 1 THEN {up.format(f'l{k}')} END AS l{k + 1} FROM ({steps[-1]})")
    return steps[-1]


def _siblings_sql(at: str) -> str:
    """For each level with several nodes the digests left and right of the node, from its place among the leaves (from 0)."""
    run, own = f"({at} // (3 ** (k + 1))::BIGINT)", f"({at} // (3 ** k)::BIGINT)"
    return f"""list_transform(list_filter(range({_TALL}), lambda k: len(levels[k + 1]) > 1), lambda k: {{'l': array_to_string(levels[k + 1][3 * {run} + 1 : {own}], ''), 'r': array_to_string(levels[k + 1][{own} + 2 : 3 * {run} + 3], '')}})"""


_LEVELS = f"[{', '.join(f'l{k}' for k in range(_TALL + 1))}]"
_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
#: The bitwise crc32 of a text of digits; 3988292384 is its polynomial.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))))"""
_OP13 = f"""
WITH d AS (
  SELECT *, {_LEAF.format('text')} AS leaf, {_LEAF.format(f"(CASE WHEN {_CRC} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END)")} AS seen FROM documents
), p AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d
), t AS (
  SELECT source, {_LEVELS} AS levels FROM ({_climb_sql('l')} ) AS z
), g AS (
  SELECT source, levels, list_filter(levels, lambda l: len(l) = 1)[1][1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM t
), u AS (
  SELECT {_LEVELS} AS levels FROM ({_climb_sql('l').replace('FROM grouped', 'FROM (SELECT list(subroot ORDER BY place) AS l FROM g)')})
), h AS (
  SELECT g.source, subroot, list_filter(u.levels, lambda l: len(l) = 1)[1][1] AS root, {_siblings_sql('place')} AS path FROM (SELECT source, subroot, place FROM g) g, u
), m AS (
  SELECT doc_id, leaf, seen, subroot, root, list_concat({_siblings_sql('pos')}, h.path) AS path
  FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source JOIN (SELECT source AS of, root, path FROM h) h ON p.source IS NOT DISTINCT FROM h.of
), f AS (
  SELECT *, CASE WHEN len(path) = 0 THEN seen ELSE list_reduce(list_concat([{{'l': seen, 'r': ''}}], path), lambda x, y: {{'l': sha256(y.l || x.l || y.r), 'r': ''}}).l END AS folded_root FROM m
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s.l || s.r), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f
""".replace("FROM grouped", "FROM (SELECT source, list(leaf ORDER BY pos) AS l FROM p GROUP BY source)")

ORACLE: dict[str, str] = {"op1_chat": _OP1, "op2_topk": _OP2, "op9_urls": _OP9, "op10_near_dups": _OP10, "op11_hard_negatives": _OP11, "op13_merkle": _OP13}
