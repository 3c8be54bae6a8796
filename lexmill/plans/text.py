"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query, table
from ..functions import text as X
from ..operators import segment

SENTENCES_SQL = r"""list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: s <> '')"""
WORDS_SQL = r"""list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')"""
FK_SQL = f"""CASE WHEN len(regexp_extract_all(text, '[A-Za-z]+')) = 0 THEN 0.0 ELSE round(greatest(
 0.39 * (len(regexp_extract_all(text, '[A-Za-z]+')) / greatest(len({SENTENCES_SQL}), 1))
 + 11.8 * (list_sum(list_transform(regexp_extract_all(lower(text), '[a-z]+'), lambda w: greatest(1, len(regexp_extract_all(w, '[aeiouy]+'))
   - CASE WHEN w LIKE '%e' AND len(regexp_extract_all(w, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END))) / len(regexp_extract_all(text, '[A-Za-z]+'))) - 15.59, 0), 3) END"""
#: User turns with the answer and the user's next turn.
TURNS_SQL = """SELECT a.conv_id, a.turn, a.text AS source, b.text AS prediction, c.text AS reference FROM conversations a
 JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 JOIN conversations c ON a.conv_id = c.conv_id AND c.turn = a.turn + 2 WHERE a.role = 'user'"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def turn_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, source, prediction, reference: a user turn and the two that follow."""
    t = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    near = t.select("conv_id", "turn", "role", F.col("text").alias("source"), *(f(c, k).over(w).alias(f"{c}{k}") for k in (1, 2) for c in ("turn", "text") for f in (F.lead,)))
    kept = near.where((F.col("role") == "user") & (F.col("turn1") == F.col("turn") + 1) & (F.col("turn2") == F.col("turn") + 2))
    return kept.select("conv_id", "turn", "source", F.col("text1").alias("prediction"), F.col("text2").alias("reference"))


@query(r"""SELECT doc_id, length(x) AS n_clean, substr(sha256(x), 1, 12) AS digest FROM (
 SELECT doc_id, trim(regexp_replace(regexp_replace(replace(text, chr(173), ''), '([\p{L}\p{N}_])-\s*\n\s*([\p{L}\p{N}_])', '\1\2', 'g'), '\s+', ' ', 'g')) AS x FROM documents)""")
def text_normalise(spark, sf_dir):
    x = X.normalise("text")
    return documents(spark, sf_dir).select("doc_id", F.length(x).cast("bigint").alias("n_clean"), X.sha_prefix(x, 12).alias("digest"))


@query(f"""SELECT lang, count(*) AS n_docs, sum(n)::BIGINT AS n_sentences, round(avg(n), 6) AS mean_sentences FROM (SELECT lang, len({SENTENCES_SQL}) AS n FROM documents) GROUP BY lang""")
def sentence_split_counts(spark, sf_dir):
    d = documents(spark, sf_dir).select("lang", F.size(X.sentences("text")).alias("n"))
    return d.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_sentences"), F.round(F.avg("n"), 6).alias("mean_sentences"))


@query(f"""SELECT source, count(*) AS n_docs, round(avg(g), 4) AS mean_grade, round(avg(CASE WHEN g <= 8 THEN 1.0 ELSE 0.0 END), 6) AS share_le_8,
 round(avg(CASE WHEN g <= 9 THEN 1.0 ELSE 0.0 END), 6) AS share_le_9 FROM (SELECT source, {FK_SQL} AS g FROM documents) GROUP BY source""")
def fk_grade_by_source(spark, sf_dir):
    d = documents(spark, sf_dir).select("source", X.fk_grade("text").alias("g"))
    share = lambda n: F.round(F.avg(F.when(F.col("g") <= n, 1.0).otherwise(0.0)), 6)
    return d.groupBy("source").agg(F.count("*").alias("n_docs"), F.round(F.avg("g"), 4).alias("mean_grade"), share(8).alias("share_le_8"), share(9).alias("share_le_9"))


@query(rf"""SELECT doc_id, array_to_string(flatten(list_transform({SENTENCES_SQL}, lambda s: CASE WHEN len(p(s)) <= 1 THEN [s] ELSE list_transform(p(s), lambda x:
 upper(substr(x, 1, 1)) || substr(x, 2) || CASE WHEN regexp_matches(x, '[.!?]$') THEN '' ELSE '.' END) END)), ' ') AS rewritten FROM documents""".replace(
    "p(s)", r"list_filter(list_transform(string_split_regex(s, '(?i);\s+|,\s+(?:and|but|or|which|who|provided that|except that)\s+'), lambda y: trim(y)), lambda z: z <> '')"
))
def clause_split_rewrite(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.split_long_clauses("text").alias("rewritten"))


@query("""SELECT doc_id, b::BIGINT AS bucket, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'validation' ELSE 'test' END AS split FROM (
 SELECT doc_id, ('0x' || substr(sha256(source || ':' || doc_id), 1, 8))::BIGINT % 100 AS b FROM documents)""")
def hash_split_assign(spark, sf_dir):
    key = F.concat_ws(":", "source", "doc_id")
    return documents(spark, sf_dir).select("doc_id", X.hash_bucket(key).alias("bucket"), X.hash_split(key).alias("split"))


@query(r"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS w FROM documents),
 s AS (SELECT doc_id, w, unnest(range(0, greatest(CASE WHEN len(w) <= 512 THEN 1 ELSE (len(w) - 512 + 447) // 448 + 1 END, 1)::BIGINT)) AS i FROM d WHERE len(w) > 0)
SELECT doc_id, i AS chunk_no, (i * 448)::BIGINT AS token_start, least(i * 448 + 512, len(w))::BIGINT AS token_end,
 nullif(regexp_extract(array_to_string(w[i * 448 + 1 : i * 448 + 512], ' '), '\[([^\]]{2,160})\]', 1), '') AS section,
 substr(sha256(array_to_string(w[i * 448 + 1 : i * 448 + 512], ' ')), 1, 12) AS digest
 FROM s WHERE least(i * 448 + 512, len(w)) - i * 448 >= 40""")
def token_chunks(spark, sf_dir):
    c = segment.token_chunks(documents(spark, sf_dir), ["doc_id"], "text", size=512, overlap=64, least=40)
    return c.select("doc_id", "chunk_no", "token_start", "token_end", X.section_tag("chunk").alias("section"), X.sha_prefix("chunk", 12).alias("digest"))


@query(r"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS w FROM documents),
 s AS (SELECT doc_id, w, unnest(range(0, ((len(w) + 255) // 256)::BIGINT)) AS i FROM d)
SELECT doc_id, i AS chunk_no, least((i + 1) * 256, len(w))::BIGINT - i * 256 AS n_tokens FROM s WHERE least((i + 1) * 256, len(w)) - i * 256 >= 128""")
def token_windows_tumbling(spark, sf_dir):
    c = segment.token_chunks(documents(spark, sf_dir), ["doc_id"], "text", size=256, overlap=0, least=128)
    return c.select("doc_id", "chunk_no", (F.col("token_end") - F.col("token_start")).alias("n_tokens"))


def _ngram_sql(text: str, n: int) -> str:
    w = f"list_filter(string_split_regex(lower({text}), '\\s+'), lambda w: w <> '')"
    return f"list_distinct(list_transform(range(1, greatest(len({w}) - {n - 1}, 0) + 1), lambda i: array_to_string({w}[i:i+{n - 1}], ' ')))"


_GRAMS = ", ".join(f"{_ngram_sql(c, n)} AS {c[0]}{n}" for n in range(1, 5) for c in ("source", "prediction", "reference"))


def _sari_sql(n: int) -> str:
    inter, diff = "list_intersect({}, {})".format, lambda a, b: f"list_filter({a}, lambda x: NOT list_contains({b}, x))"
    s, p, r = f"s{n}", f"p{n}", f"r{n}"

    def share(a: str, b: str) -> tuple[str, str]:
        none = f"WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0"
        return tuple(f"(CASE {none} WHEN len({x}) = 0 THEN 0.0 ELSE len({inter(a, b)}) / len({x}) END)" for x in (a, b))

    f1 = lambda a, b: "coalesce(2 * {0} * {1} / nullif({0} + {1}, 0), 0.0)".format(*share(a, b))
    return f"({f1(inter(p, s), inter(r, s))} + {f1(diff(p, s), diff(r, s))} + {share(diff(s, p), diff(s, r))[0]}) / 3"


@query(f"SELECT conv_id, turn, round(100 * ({' + '.join(_sari_sql(n) for n in range(1, 5))}) / 4, 6) AS sari FROM (SELECT conv_id, turn, {_GRAMS} FROM ({TURNS_SQL}))")
def sari_scores(spark, sf_dir):
    return turn_triples(spark, sf_dir).select("conv_id", "turn", F.round(X.sari("source", "prediction", "reference"), 6).alias("sari"))


@query(rf"""WITH t AS ({TURNS_SQL}), a AS (SELECT conv_id, turn, unnest(list_filter(string_split_regex(lower(prediction), '\s+'), lambda w: w <> '')) AS w FROM t),
 b AS (SELECT conv_id, turn, unnest(list_filter(string_split_regex(lower(reference), '\s+'), lambda w: w <> '')) AS w FROM t),
 ac AS (SELECT conv_id, turn, w, count(*) AS n FROM a GROUP BY ALL), bc AS (SELECT conv_id, turn, w, count(*) AS n FROM b GROUP BY ALL),
 o AS (SELECT conv_id, turn, sum(least(ac.n, bc.n)) AS o FROM ac JOIN bc USING (conv_id, turn, w) GROUP BY ALL),
 na AS (SELECT conv_id, turn, sum(n) AS n FROM ac GROUP BY ALL), nb AS (SELECT conv_id, turn, sum(n) AS n FROM bc GROUP BY ALL)
SELECT t.conv_id, t.turn, round(coalesce(2 * (o / na.n) * (o / nb.n) / (o / na.n + o / nb.n), 0.0), 6) AS token_f1
 FROM t LEFT JOIN o USING (conv_id, turn) LEFT JOIN na USING (conv_id, turn) LEFT JOIN nb USING (conv_id, turn)""")
def token_f1(spark, sf_dir):
    return turn_triples(spark, sf_dir).select("conv_id", "turn", F.round(X.token_f1("prediction", "reference"), 6).alias("token_f1"))


_NUM = r"list_distinct(list_transform(regexp_extract_all({}, '(?:€|£|\$)?\d[\d,.%]*'), lambda t: rtrim(regexp_replace(t, '[€£$%,\s]', '', 'g'), '.')))"
_NEG = r"regexp_matches({}, '(?i)\b(no|not|never|without|unless)\b')"


@query(f"""SELECT conv_id, turn, len({_NUM.format('source')})::BIGINT AS n_source_numbers,
 len(list_filter({_NUM.format('prediction')}, lambda x: NOT list_contains({_NUM.format('source')}, x))) = 0 AND {_NEG.format('source')} = {_NEG.format('prediction')} AS preserved FROM ({TURNS_SQL})""")
def critical_tokens_preserved(spark, sf_dir):
    return turn_triples(spark, sf_dir).select(
        "conv_id", "turn", F.size(X.numbers("source")).cast("bigint").alias("n_source_numbers"), X.critical_tokens_preserved("source", "prediction").alias("preserved")
    )


_M = X.MONTHS


def _facts_sql(t: str) -> dict[str, str]:
    low = lambda p: rf"list_sort(list_distinct(list_transform(regexp_extract_all({t}, '{p}'), lambda x: lower(trim(regexp_replace(x, '\s+', ' ', 'g'))))))"
    return {
        "number": rf"list_sort(list_distinct(list_transform(regexp_extract_all({t}, '(?i)(?:^|[^A-Za-z0-9_$£€.,])((?:[$£€])?\d[\d,]*(?:\.\d+)?)', 1), lambda x: lower(x))))",
        "date": low(rf"(?i)\b(?:\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|{_M}\s+\d{{1,2}}(?:,\s*)?\d{{4}}|\d{{1,2}}\s+{_M}\s+\d{{4}})\b"),
        "percentage": low(r"(?i)\b\d+(?:\.\d+)?\s*(?:%|percent)\b"),
        "negation": low("(?i)\\b(?:no|not|never|without|unless|cannot|can''t|won''t|mustn''t|may not)\\b"),
    }


_ENT = r"list_sort(list_distinct(list_transform(list_concat(regexp_extract_all({0}, '\b(?:[A-Z][A-Za-z&.-]+\s+){{0,4}}(?:Bank|Bureau|Company|Corp(?:oration)?|Credit Union|Financial|Inc|LLC|Ltd|Services)\b'), regexp_extract_all(regexp_replace({0}, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g'), '(?:^|[^\p{{L}}\p{{N}}_])([A-Z]{{2,8}})(?:$|[^\p{{L}}\p{{N}}_])', 1)), lambda x: lower(trim(regexp_replace(x, '\s+', ' ', 'g'))))))"
_REQ = r"regexp_matches({}, '(?i)\b(?:must|shall|required|need(?:s)? to|has to|have to)\b')"
_PRO = r"regexp_matches({}, '(?i)\b(?:must not|shall not|may not|cannot|can''t|prohibited)\b')"
_S, _P = _facts_sql("source"), _facts_sql("prediction")
_CHECKS = ", ".join(f"CASE WHEN {_S[k]} <> {_P[k]} THEN '{k}' END" for k in _S)


@query(f"""SELECT conv_id, turn, array_to_string(list_filter([{_CHECKS}, CASE WHEN {_ENT.format('source')} <> {_ENT.format('prediction')} THEN 'entity' END,
 CASE WHEN {_REQ.format('source')} <> {_REQ.format('prediction')} OR {_PRO.format('source')} <> {_PRO.format('prediction')} THEN 'obligation' END], lambda x: x IS NOT NULL), ',') AS failed FROM ({TURNS_SQL})""")
def preservation_checks(spark, sf_dir):
    return turn_triples(spark, sf_dir).select("conv_id", "turn", F.array_join(X.preservation_failures("source", "prediction"), ",").alias("failed"))


@query(r"""SELECT doc_id, 'For the avoidance of doubt and subject to all applicable provisos, carve-outs, schedules, and cross-referenced definitions, ' || text AS technical,
 array_to_string(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')[1:30], ' ') AS short FROM documents""")
def perturbations(spark, sf_dir):
    from ..operators.stress import CONDITIONS

    d = documents(spark, sf_dir)
    return d.select("doc_id", CONDITIONS["technical_derivative_language"](F.col("text")).alias("technical"), CONDITIONS["very_short_or_truncated"](F.col("text")).alias("short"))


@query(r"""WITH l AS (SELECT doc_id, pos - 1 AS pos, line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(ls) WITH ORDINALITY AS t(line, pos))
SELECT doc_id, count(*) AS n_lines, sum(CASE WHEN len(list_filter(string_split_regex(trim(line), '\s+'), lambda w: w <> '')) <= 12 AND (regexp_full_match(trim(line), '[A-Z][A-Z0-9 /&(),.''-]{3,100}') OR trim(line) LIKE '%:') THEN 1 ELSE 0 END)::BIGINT AS n_headings,
 sum(CASE WHEN regexp_matches(trim(line), '(?is)^\s*((?:\((?:\d+(?:\.\d+)*|[A-Z]|[IVXLC]+)\)|\d+(?:\.\d+)+(?:[.)])?|\d+[.)]|[A-Z][.)]|[IVXLC]+[.)]))\s*(.*)$') THEN 1 ELSE 0 END)::BIGINT AS n_numbered
 FROM l WHERE trim(line) <> '' GROUP BY doc_id""")
def line_kinds(spark, sf_dir):
    lines = segment.lines(documents(spark, sf_dir), ["doc_id"], "text")
    return lines.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.count_if(X.is_heading(F.col("line"))).alias("n_headings"), F.count_if(X.is_numbered(F.col("line"))).alias("n_numbered")
    )
