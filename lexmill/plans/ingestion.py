"""Ingestion queries: shapes of incoming rows, pages, replies and sheets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import query, table
from ..functions import text as X
from ..operators.matching import match_clauses, tasks
from ..session import ship
from ..sources import files as S
from ..sources import normalise as N
from .text import documents

_WORDS = r"len(list_filter(string_split_regex({}, '\s+'), lambda w: w <> ''))"


@query(f"SELECT 'conv:' || conv_id || ':' || turn AS source_id, trim(text) AS text, role AS product FROM conversations WHERE {_WORDS.format('text')} >= 10")
def complaint_narratives(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").withColumn("narrative", F.lit(None).cast("string")).withColumn("complaint", F.lit("  "))
    rows = t.select(F.concat(F.lit("conv:"), "conv_id", F.lit(":"), "turn").alias("source_id"), X.first_text("narrative", "complaint", "text").alias("text"), F.col("role").alias("product"))
    return rows.where(X.word_count("text") >= 10)


@query(f"SELECT doc_id, length(t) AS n FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN trim(text) WHEN doc_id % 3 = 1 THEN lang || ' ' || source || ' ' || text ELSE source || chr(10) || chr(10) || text END AS t FROM documents) WHERE {_WORDS.format('t')} >= 20")
def filing_texts(spark, sf_dir):
    d = documents(spark, sf_dir)
    shaped = d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).alias("text"), *(F.when(F.col("doc_id") % 3 == 1, F.col(c)).alias(a) for c, a in (("lang", "instruction"), ("source", "input"), ("text", "output"))),
                      F.when(F.col("doc_id") % 3 == 2, F.col("source")).alias("section_1"), F.when(F.col("doc_id") % 3 == 2, F.col("text")).alias("section_2"))
    t = F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.nullif(F.concat_ws(" ", "instruction", "input", "output"), F.lit("")), F.nullif(F.concat_ws("\n\n", "section_1", "section_2"), F.lit("")))
    return shaped.select("doc_id", t.alias("t")).where(X.word_count("t") >= 20).select("doc_id", F.length("t").cast("bigint").alias("n"))


@query("SELECT doc_id, lang FROM documents ORDER BY md5('7:' || doc_id) LIMIT 50")
def raw_stream_sample(spark, sf_dir):
    return N.sample_rows(documents(spark, sf_dir).select("doc_id", "lang"), 7, "doc_id", 50)


@query("SELECT doc_id FROM documents WHERE ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 100 BETWEEN 80 AND 89")
def partitioned_split_scan(spark, sf_dir):
    return N.partitioned(documents(spark, sf_dir), "validation", "doc_id").select("doc_id")


@query("SELECT min(doc_id) AS doc_id, text AS premise FROM documents WHERE len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) >= 5 GROUP BY text")
def distinct_premises(spark, sf_dir):
    d = documents(spark, sf_dir).where(X.word_count("text") >= 5)
    return d.groupBy(F.col("text").alias("premise")).agg(F.min("doc_id").alias("doc_id"))


@query("""SELECT conv_id || '::' || turn || '::' || substr(sha256(text), 1, 12) AS clause_key FROM conversations""")
def clause_key_synthesis(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.concat_ws("::", F.coalesce(F.col("conv_id").cast("string"), F.lit("unknown-conversation")), F.coalesce(F.col("turn").cast("string"), F.lit("unknown-turn")), X.sha_prefix("text", 12)).alias("clause_key"))


@query("""SELECT 'documents' AS source, 'ok' AS status, (SELECT count(*) FROM (SELECT * FROM documents LIMIT 5)) AS n UNION ALL SELECT 'pages', 'ok', (SELECT count(*) FROM (SELECT * FROM pages LIMIT 5)) UNION ALL SELECT 'absent', 'error', 0""")
def source_health(spark, sf_dir):
    found = []
    for name in ("documents", "pages", "absent"):
        try:
            found.append((name, "ok", table(spark, sf_dir, name).limit(5).count()))
        except Exception:  # a source that fails is a row of the report
            found.append((name, "error", 0))
    return spark.createDataFrame(found, "source string, status string, n bigint")


@query(r"""WITH h AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/]+)', 1) AS root, regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1) AS hs FROM pages),
 l AS (SELECT page_id, url, pos - 1 AS pos, CASE WHEN regexp_matches(href, '^[a-z]+://') THEN href WHEN starts_with(href, '/') THEN root || href END AS link, root FROM h, unnest(hs) WITH ORDINALITY AS t(href, pos))
SELECT page_id, link, min(pos)::BIGINT AS pos FROM l WHERE regexp_extract(link, '^([a-z]+://[^/]+)', 1) = root AND link <> url AND NOT regexp_matches(link, '(?i)\.(jpg|png|css|js|zip)$') GROUP BY ALL""")
def same_host_links(spark, sf_dir):
    return S.same_host_links(table(spark, sf_dir, "pages"), "page_id", "url", "html")


@query()
def html_sections(spark, sf_dir):
    ship(spark)
    return table(spark, sf_dir, "pages").select("page_id", S.html_text("html").alias("text"))


@query(r"""SELECT doc_id, array_to_string(list_concat([chr(10) || '## Part ' || source || chr(10)], list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(regexp_replace(l, '\s+', ' ', 'g'))), lambda l: l <> ''), lambda l: '[Part ' || source || '] ' || l)), chr(10)) AS text FROM documents""")
def xml_sections(spark, sf_dir):
    """Documents marked up as a regulation's XML and read as lines under their heading."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&#62;"))
    lines = F.transform(F.split(safe(F.col("text")), "\n"), lambda x: F.concat(F.lit("<P>"), x, F.lit("</P><!-- <P>no</P> -->")))
    xml = F.concat(F.lit('<?xml version="1.0"?><DIV N="1"><HEAD>Part <I>'), safe(F.col("source")), F.lit("</I></HEAD>"), F.array_join(lines, "<PRTPAGE P='7'/>"), F.lit("</DIV>"))
    return documents(spark, sf_dir).select("doc_id", S.xml_text(xml).alias("text"))


def turn_pairs(spark, sf_dir):
    """id, turn, a, b: a turn of a conversation and the one after it."""
    t = table(spark, sf_dir, "conversations")
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return t.join(after, ["conv_id", "turn"]).select(F.concat_ws(":", "conv_id", "turn").alias("id"), "turn", F.col("text").alias("a"), "b")


_PAIRS = "SELECT a.conv_id || ':' || a.turn AS id, a.turn, a.text AS a, b.text AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"


@query(f"""WITH p AS ({_PAIRS})
SELECT * FROM (SELECT id AS source_id, trim(a) AS premise, trim(regexp_replace(b, '\\n+$', '')) AS hypothesis, 'contradiction' AS label FROM p WHERE turn % 4 = 0 UNION ALL SELECT id, trim(a), trim(b), 'entailment' FROM p WHERE turn % 4 = 1
 UNION ALL SELECT id || '::0', trim(a), trim(b), 'entailment' FROM p WHERE turn % 4 = 2 UNION ALL SELECT id || '::1', trim(a), 'Not so: ' || trim(b), 'contradiction' FROM p WHERE turn % 4 = 2
 UNION ALL SELECT id, trim(a), trim(substr(a, 1, 300)), 'neutral' FROM p WHERE turn % 4 = 3) WHERE premise <> '' AND hypothesis <> ''""")
def nli_shape_union(spark, sf_dir):
    """Neighbouring turns in the three shapes of the corpora, made into pairs of one shape."""
    p, kind = turn_pairs(spark, sf_dir), F.col("turn") % 4
    of = lambda *ks: kind.isin(*ks)
    rows = p.select(
        "id",
        F.when(of(0), F.concat(F.lit("Q: "), "b", F.lit("\n\nContext: "), "a")).when(of(3), F.col("a")).alias("input"), F.when(of(0), "Contradiction").when(of(3), "not mentioned").alias("output"),
        F.when(of(1, 2), F.col("a")).alias("premise"), F.when(of(1), F.col("b")).alias("hypothesis"), F.when(of(1), "1").alias("label"),
        F.when(of(2), F.array("b", F.concat(F.lit("Not so: "), F.trim("b")), F.lit(" "))).alias("hypotheses"), F.when(of(2), F.array(F.lit("Entailment"), F.lit("contradiction"))).alias("labels"),
    )
    return N.contract_pairs(rows)


@query("""WITH c AS (SELECT a.conv_id, a.turn, a.text AS premise, b.text AS hypothesis, CASE (a.turn % 4)::INT WHEN 0 THEN 'entailment' WHEN 1 THEN 'neutral' WHEN 2 THEN 'contradiction' END AS label FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT premise, hypothesis, label, conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY premise, hypothesis ORDER BY conv_id, turn) AS rn FROM c WHERE label IS NOT NULL AND trim(premise) <> '' AND trim(hypothesis) <> '') WHERE rn = 1""")
def valid_unique_pairs(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hypothesis"))
    code = F.col("turn") % 4
    pairs = t.select("conv_id", "turn", F.col("text").alias("premise")).join(after, ["conv_id", "turn"])
    label = F.when(code < 3, N.nli_code(code, ["entailment", "neutral", "contradiction"]))
    return N.valid_unique_pairs(pairs.withColumn("label", label), ["conv_id", "turn"]).select("premise", "hypothesis", "label", "conv_id", "turn")


@query("""WITH l AS (SELECT 'q' || doc_id AS id, doc_id % 4 AS k, trim('What of ' || source || '?') AS question, CASE WHEN doc_id % 8 = 7 THEN ' ' ELSE lang END AS answer, lang, string_split(text, chr(10)) AS ls FROM documents),
 e AS (SELECT id, k, question, answer, lang, i, ls[1] AS t, CASE WHEN k = 0 THEN lang ELSE NULL END AS own, NULL::VARCHAR AS item_doc, NULL::VARCHAR AS page FROM l, (SELECT 0 AS i) WHERE k = 0
  UNION ALL SELECT id, k, question, answer, lang, i, ls[i + 1], NULL, CASE WHEN i = 0 THEN lang END, CASE i WHEN 0 THEN '7' WHEN 1 THEN 'x' END FROM l, (SELECT unnest([0, 1, 2]) AS i) WHERE k IN (1, 2)
  UNION ALL SELECT id, k, question, answer, lang, i, CASE WHEN i = 1 THEN ls[1] ELSE ' ' END, 'own', NULL, CASE WHEN i = 1 THEN '2' END FROM l, (SELECT unnest([0, 1]) AS i) WHERE k = 3)
SELECT id AS example_id, question, trim(answer) AS answer, 'FB-' || substr(sha256(id || chr(0) || i || chr(0) || trim(t)), 1, 16) AS chunk_id, trim(t) AS text, coalesce(item_doc, own) AS doc_name, try_cast(page AS INTEGER) AS page FROM e WHERE trim(answer) <> '' AND trim(coalesce(t, '')) <> ''""")
def qa_normalise_dedupe(spark, sf_dir):
    """Questions with evidence as a text, as parallel lists and as items, from the documents; each piece of evidence once."""
    kind, ls = F.col("doc_id") % 4, F.split("text", "\n")
    none = F.lit(None).cast("string")
    rows = documents(spark, sf_dir).select(
        F.concat(F.lit("q"), "doc_id").alias("id"), F.concat(F.lit(" What of "), "source", F.lit("? ")).alias("question"), F.when(F.col("doc_id") % 8 == 7, " ").otherwise(F.col("lang")).alias("answer"),
        F.when(kind == 0, F.col("lang")).when(kind == 3, "own").alias("doc_name"), F.when(kind == 0, F.get(ls, F.lit(0))).alias("evidence_text"),
        F.when(kind.isin(1, 2), F.struct(F.slice(ls, 1, 3).alias("text"), F.array("lang").alias("doc_name"), F.array(F.lit("7"), F.lit("x")).alias("page"))).alias("evidence_lists"),
        F.when(kind == 3, F.array(F.struct(F.lit(" ").alias("text"), none.alias("doc_name"), none.alias("page")), F.struct(F.get(ls, F.lit(0)).alias("text"), none.alias("doc_name"), F.lit("2").alias("page")))).alias("evidence_items"),
    )
    return N.qa_examples(rows).dropDuplicates(["chunk_id"])


@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'a' || conv_id WHEN 1 THEN 'b' || turn WHEN 2 THEN '3' END AS source_id, CASE WHEN turn % 4 < 3 THEN text END AS text FROM conversations""")
def json_repair(spark, sf_dir):
    """Turns wrapped as the replies of a service (fences, talk, envelopes, other names, no JSON), and their items read again."""
    ship(spark)
    kind = F.col("turn") % 4
    item = lambda id_name, id_value, text_name: F.to_json(F.struct(id_value.alias(id_name), F.col("text").alias(text_name)))
    reply = (
        F.when(kind == 0, F.concat(F.lit('```json\n{"items": ['), item("id", F.concat(F.lit("a"), "conv_id"), "simplified"), F.lit("]}\n```")))
        .when(kind == 1, F.concat(F.lit("Sure: ["), item("source_id", F.concat(F.lit("b"), "turn"), "text"), F.lit("] done")))
        .when(kind == 2, item("record_id", F.lit(3), "output")).otherwise(F.concat(F.lit("no answer {"), "role"))
    )
    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", F.explode_outer(S.reply_items(reply)).alias("item")).select("conv_id", "turn", "item.*")


@query("""WITH g AS (SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars, list_sort(list_distinct(list(lang))) AS langs FROM documents GROUP BY source)
SELECT source AS artefact, 'size.docs' AS metric, n::VARCHAR AS value FROM g UNION ALL SELECT source, 'size.chars.sum', chars::VARCHAR FROM g UNION ALL SELECT source, 'langs', '[' || array_to_string(list_transform(langs, lambda l: '"' || l || '"'), ', ') || ']' FROM g
 UNION ALL SELECT source, 'many', CASE WHEN n > 20 THEN 'true' ELSE 'false' END FROM g""")
def consolidate_flatten(spark, sf_dir):
    """Each source's figures as a nested artefact, flattened to dotted names."""
    ship(spark)
    g = documents(spark, sf_dir).groupBy(F.col("source").alias("artefact")).agg(F.count("*").alias("docs"), F.sum("n_chars").alias("sum"), F.array_sort(F.collect_set("lang")).alias("langs"))  # a few languages
    size = F.struct("docs", F.struct("sum").alias("chars"))
    payload = F.to_json(F.struct(size.alias("size"), "langs", F.array(F.struct("docs")).alias("rows"), F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: i).alias("long"), (F.col("docs") > 20).alias("many")))
    return g.select("artefact", F.explode(S.flat_metrics(payload)).alias("m")).select("artefact", "m.*")


@query()
def fuzzy_clause_match(spark, sf_dir):
    gold = F.filter(F.split("text", "\n"), lambda x: F.length(x) > 20)
    noisy = F.transform("gold", lambda x: F.replace(x, F.lit("th"), F.lit("h")))
    docs = documents(spark, sf_dir).select("doc_id", "text").repartition(tasks(spark), "doc_id")  # matching takes long for its bytes
    return S.parser_scores(match_clauses(docs.select("doc_id", gold.alias("gold")).withColumn("predicted", noisy), "doc_id"), "doc_id")


RECORD = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.BooleanType()), T.StructField("score", T.DoubleType())])


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE quality END AS quality, toxic = 1 AS toxic, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id / 4.0::DOUBLE END AS score FROM labels")
def typed_record_scan(spark, sf_dir):
    i = F.col("doc_id")
    raw = table(spark, sf_dir, "labels").select(
        i.cast("string").alias("doc_id"), F.when(i % 7 == 0, "None").otherwise(F.col("quality").cast("string")).alias("quality"), F.when(F.col("toxic") == 1, "Yes").otherwise("0").alias("toxic"),
        F.when(i % 5 == 0, "").otherwise((i / 4.0).cast("string")).alias("score"), F.lit("dropped").alias("unknown"),
    )
    return N.typed_records(raw, RECORD)


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN quality WHEN doc_id % 3 = 1 THEN 1 - quality END AS answer FROM labels")
def reviewer_values(spark, sf_dir):
    i = F.col("doc_id")
    said = F.when(F.col("quality") == 1, " Yes").otherwise("no")
    r = table(spark, sf_dir, "labels").select("doc_id", F.when(i % 3 == 0, said).otherwise("maybe").alias("a"), F.when(i % 3 == 1, said).alias("b"))
    return r.select("doc_id", F.coalesce(N.yes_no("a"), 1 - N.yes_no("b")).alias("answer"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 5 * 60 + 2.5 WHEN event_id % 3 = 1 THEN (event_id % 9)::DOUBLE END AS seconds FROM events")
def retry_after(spark, sf_dir):
    i = F.col("event_id")
    said = F.when(i % 3 == 0, F.concat(F.lit("Please Try again in "), i % 5, F.lit("m2.5s."))).when(i % 3 == 1, F.concat(F.lit("try again in "), i % 9, F.lit("s"))).otherwise("rate limited")
    return table(spark, sf_dir, "events").select("event_id", X.retry_after(said).alias("seconds"))


@query("SELECT l_orderkey, l_linenumber, round(0.1 + 0.9 * (0.6 * least(greatest(l_quantity / 50, 0), 1) + 0.4 * least(greatest(l_discount * 10, 0), 1)), 6) AS weight FROM lineitem")
def quality_weights(spark, sf_dir):
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(0.1 + 0.9 * (0.6 * clip(F.col("l_quantity") / 50) + 0.4 * clip(F.col("l_discount") * 10)), 6).alias("weight"))


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE / n) * (x::DOUBLE / n))), 6) AS norm FROM (SELECT vec_id, embedding, CASE WHEN s = 0 THEN 1 ELSE sqrt(s) END AS n FROM (SELECT vec_id, embedding, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS s FROM embeddings))""")
def l2_normalised(spark, sf_dir):
    v = X.l2_normalise("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"))


@query("SELECT event_id, round(exp(value / 100 / 2) / (exp(value / 100 / 2) + exp((event_id % 3) / 2.0::DOUBLE) + 1), 6) AS p FROM events")
def softmax_temperature(spark, sf_dir):
    p = X.softmax(F.col("value") / 100, (F.col("event_id") % 3).cast("double"), F.lit(0.0), temperature=2.0)
    return table(spark, sf_dir, "events").select("event_id", F.round(p[0], 6).alias("p"))


@query("SELECT conv_id, turn, least(0.1 + turn * 0.15, 0.7)::DOUBLE AS temperature, least(pow(2, turn), 8)::DOUBLE AS backoff, conv_id * 31 % 26 / 100.0::DOUBLE AS jitter FROM conversations")
def retry_schedule(spark, sf_dir):
    """Turns as attempts: rising temperature, and a wait that doubles up to a bound with a seeded jitter of a quarter at most."""
    n = F.col("turn")
    jitter = F.col("conv_id") * 31 % 26 / 100.0
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.round(F.least(0.1 + n * 0.15, F.lit(0.7)), 9).alias("temperature"), F.least(F.pow(F.lit(2.0), n.cast("double")), F.lit(8.0)).alias("backoff"), jitter.alias("jitter")
    )


@query("""WITH x AS (SELECT vec_id // 8 AS seq_id, CASE WHEN vec_id // 8 % 5 = 0 THEN 0 WHEN vec_id % 3 <> 0 THEN 1 ELSE 0 END AS m, i - 1 AS component, e::DOUBLE AS e FROM embeddings, unnest(embedding) WITH ORDINALITY AS u(e, i))
SELECT seq_id, component::INT AS component, round(sum(m * e) / greatest(sum(m), 1), 6) + 0.0 AS pooled FROM x GROUP BY ALL""")
def mean_pooled(spark, sf_dir):
    """Eight vectors a sequence as its tokens, pooled under a mask; every fifth sequence is masked whole."""
    i = F.col("vec_id")
    keep = F.when(F.floor(i / 8) % 5 == 0, 0).when(i % 3 != 0, 1).otherwise(0)
    tokens = table(spark, sf_dir, "embeddings").groupBy(F.floor(i / 8).cast("bigint").alias("seq_id")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding", keep.alias("m")))).alias("t"))  # eight a sequence
    pooled = X.mean_pool(F.transform("t", lambda x: x["embedding"]), F.transform("t", lambda x: x["m"]))
    return tokens.select("seq_id", F.posexplode(pooled).alias("component", "x")).select("seq_id", "component", (F.round("x", 6) + 0.0).alias("pooled"))
