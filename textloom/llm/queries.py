"""Registered queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, exact_dedup, lm, mixing, near_dedup, packing, quality, rollups, simhash, tokens, topk, toxicity, turns, wavelet
from .common import prepare, scratch_path, table, tidied, written


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(prepare(spark), sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(prepare(spark), sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes_of(table(prepare(spark), sf_dir, "documents"))


def op5_norm_sorted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(prepare(spark), sf_dir, "embeddings")
    return topk.search(vectors, vectors.filter("vec_id % 50 = 0"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(prepare(spark), sf_dir, "documents"), form="none", keep="largest")


def op7_masked_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, made = lm.train(table(prepare(spark), sf_dir, "documents"))
    return lm.scored(made, model)


def op8_token_count_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history over the whole table: counts estimated by length come in, are revised to what the tokenizer says, half of the documents go and come back.

    Its totals are those of the table, every row counted; a snapshot is written on the way.
    """
    store = rollups.Store(spark, scratch_path(spark, "rollups"), compacted=3)
    docs, versions = table(prepare(spark), sf_dir, "documents"), {"words/1": None, "byte_bpe_50k/1": (tokens.public("byte_bpe_50k.json"), False)}
    told = rollups.in_parts(docs)
    guesses = told.filter("doc_id IS NOT NULL").select(F.lit("insert").alias("op"), "doc_id", "part", "copies", "source", "lang", F.explode(F.array(*map(F.lit, versions))).alias("tokenizer"), (F.length("text") / 4).cast("long").alias("tokens"))
    store.commit("estimated", guesses)
    store.commit("encoded", rollups.token_counts(docs, versions).withColumn("op", F.when(F.col("doc_id").isNull(), "insert").otherwise("revise")))
    half = written(store.counts().filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), "rollups-half")
    store.commit("taken out", half.withColumn("op", F.lit("delete")))
    store.commit("put back", half.withColumn("op", F.lit("insert")))
    store.commit("encoded", guesses)  # a name that is there changes nothing
    return store.totals()


def op9_wavelet_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = wavelet.write(table(prepare(spark), sf_dir, "documents"), tokens.public("word_bpe_49k.json"), True, 2)
    return wavelet.read(spark, path)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(prepare(spark), sf_dir, "documents"), tokens.public("byte_bpe_50k.json"), False, 0)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, also those of which the damage leaves no turn."""
    told = table(prepare(spark), sf_dir, "conversations")
    made = turns.repaired(turns.damaged(told)).withColumnRenamed("conv_id", "c")
    every = told.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = every.join(made, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce("repaired", F.lit("")).cast("binary"), 256).alias("repaired_sha256"))


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes_of(table(prepare(spark), sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(prepare(spark), sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    """All queries; of the tables that they write, those that their results don't read are gone when they return."""
    return {"pipeline": pipeline} | {k: tidied(v) for k, v in globals().items() if k.startswith("op") and callable(v)}


def _mixing_sql() -> str:
    """The whole mix in SQL: targets, class scaling, numbers of each class, Pareto ranks."""
    w = ", ".join(f"{float(x)}" for x in mixing.WEIGHTS)
    falls = ", ".join(str(mixing.class_weight(c)) for c in range(mixing.TOP_OCTAVE + 1))
    most, n = float(mixing.MOST_COPIES), len(mixing.WEIGHTS)
    return rf"""
WITH RECURSIVE d0 AS (SELECT row_number() OVER () AS rid, doc_id, source, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS h, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents)
, d AS (SELECT *, md5(concat('/', coalesce(doc_id::VARCHAR, 'null'), '/', h, '/', row_number() OVER (PARTITION BY source, doc_id, h) - 1)) AS digest FROM d0)
, s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)
, r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s)
, rw AS (SELECT *, ([{w}])[(place % {n})::INT + 1]::DOUBLE AS weight, (sum(source_size) OVER ())::DOUBLE * {mixing.SHARE} AS goal FROM r)
, lv AS (SELECT *, (goal - coalesce(sum(source_size) OVER b, 0)::DOUBLE * {most}) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
    FROM rw WINDOW b AS (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
, line AS (SELECT arg_min(level, (source_size / weight, place)) AS line FROM lv WHERE level * weight <= source_size * {most})
, t AS (SELECT source, source_size, coalesce(least(source_size * {most}, line * weight), source_size * {most}) AS target FROM lv LEFT JOIN line ON true)
, dc AS (SELECT d.*, CASE WHEN length(bin(size + 1)) - 1 < {mixing.TOP_OCTAVE} THEN (length(bin(size + 1)) - 1) * {mixing.PARTS} + (((size + 1) * {mixing.PARTS}) >> (length(bin(size + 1)) - 1)) - {mixing.PARTS} ELSE {mixing.TOP_OCTAVE * mixing.PARTS} END::INT AS class FROM d)
, k AS (SELECT c.source, c.class, c.words, c.docs, t.source_size, t.target, ([{falls}])[c.class // {mixing.PARTS} + 1]::BIGINT AS w
    FROM (SELECT source, class, sum(size)::BIGINT AS words, count(*) AS docs FROM dc GROUP BY ALL) c JOIN t ON t.source IS NOT DISTINCT FROM c.source)
, kl AS (SELECT *, CASE WHEN mass = 0 THEN 0 ELSE (target - f * {most}) / mass END AS level FROM (
    SELECT *, coalesce(sum(words) OVER b, 0)::DOUBLE AS f, ((sum(words * w) OVER (PARTITION BY source)) - coalesce(sum(words * w) OVER b, 0))::DOUBLE AS mass
    FROM k WINDOW b AS (PARTITION BY source ORDER BY class ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))
, kf AS (SELECT *, arg_min(level, class) FILTER (level * w <= {most}) OVER (PARTITION BY source) AS lev FROM kl)
, kc AS (SELECT *, least({most}, greatest(0.0, coalesce(lev * w, {most}))) AS x FROM kf)
, rate AS (SELECT source, class, words, docs, source_size, target, CASE WHEN abs(x - round(x)) < 1e-9 THEN round(x) ELSE x END AS copies FROM kc)
, n0 AS (SELECT *, copies - floor(copies) AS p, floor((copies - floor(copies)) * words * {mixing.FINE} + 0.5)::BIGINT AS e,
    (('0x' || substr(md5(concat('/class/', coalesce(source, 'null'), '/', class)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM rate WHERE copies > floor(copies) AND words > 0)
, n1 AS (SELECT *, (sum(e) OVER (PARTITION BY source ORDER BY class))::BIGINT AS rest, row_number() OVER (PARTITION BY source ORDER BY class DESC) AS i FROM n0)
, n2 AS (SELECT source, 0::BIGINT AS i, NULL::INT AS class, 0::BIGINT AS take, 0::BIGINT AS over, 0.0::DOUBLE AS most FROM n1 GROUP BY source
    UNION ALL SELECT source, i, class, take, over + floor((take * words * {mixing.FINE})::DOUBLE / docs::DOUBLE)::BIGINT - e, most * (1.0::DOUBLE - share * e) + (words * {mixing.FINE})::DOUBLE / docs::DOUBLE FROM (
    SELECT *, least(docs, floor(p * docs * (1.0::DOUBLE - share * over) + u)::BIGINT) AS take FROM (
    SELECT n1.*, n2.over, n2.most, CASE WHEN most > 0 AND rest > 0 THEN least(1.0::DOUBLE / rest::DOUBLE, least(1.0::DOUBLE, (1.0::DOUBLE - p) / p) / most) ELSE 0.0::DOUBLE END AS share
    FROM n2 JOIN n1 ON n1.source IS NOT DISTINCT FROM n2.source AND n1.i = n2.i + 1)))
, u AS (SELECT dc.*, rate.source_size, rate.target, rate.copies, copies - floor(copies) AS p,
    (('0x' || substr(digest, 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
    FROM dc JOIN rate ON rate.source IS NOT DISTINCT FROM dc.source AND rate.class = dc.class)
, q AS (SELECT *, CASE WHEN p > 0 THEN (u / (1.0 - u)) / (p / (1.0 - p)) END AS q FROM u)
, pool AS (SELECT rid, source, class, row_number() OVER (PARTITION BY source, class ORDER BY least(q / (1.0 + q), 1 - 1.1102230246251565e-16), ('0x' || substr(digest, 14, 15))::BIGINT) AS place FROM q WHERE p > 0 AND size > 0)
, more AS (SELECT pool.rid FROM pool JOIN n2 ON pool.source IS NOT DISTINCT FROM n2.source AND pool.class = n2.class WHERE pool.place <= n2.take)
SELECT doc_id, source, size, source_size, target, ((floor(copies) + CASE WHEN rid IN (SELECT rid FROM more) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM q"""


_OP4 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents)
, s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(ws) - {near_dedup.WORDS - 1}, 1) + 1), lambda i: array_to_string(list_slice(ws, i, i + {near_dedup.WORDS - 1}), ' ')))) END AS sh FROM w)
, m AS (SELECT doc_id, len(sh) AS n, md5(array_to_string(sh, chr(10))) AS node FROM s)
, c AS (SELECT min(m.doc_id) AS id, m.node, any_value(s.sh) AS sh, any_value(m.n) AS n FROM m JOIN s USING (doc_id) WHERE m.n > 0 GROUP BY m.node)
, x AS (SELECT id, n, unnest(sh) AS v FROM c)
, e AS (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.v = b.v AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*)))
, e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e)
, reach AS (SELECT id, id AS root FROM c UNION SELECT e2.b, reach.root FROM reach JOIN e2 ON e2.a = reach.id)
, top AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
SELECT m.doc_id, m.n::BIGINT AS n_shingles, coalesce(top.root, m.doc_id) AS component_id, m.doc_id = coalesce(top.root, m.doc_id) AS kept
FROM m LEFT JOIN c ON c.node = m.node AND m.n > 0 LEFT JOIN top ON top.id = c.id"""

_OP5 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
, s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s) WHERE rank <= 5"""

_OP6 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW g AS (PARTITION BY t)"""


def _repair_sql() -> str:
    """The fold in SQL: a state is a string of the cost's nine digits and the audit, so that the least string is the best state."""
    plus = lambda x, cost, letter: f"(lpad((left({x}, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({x}, 10) || {letter})"
    gone = lambda x: plus(x, turns.DELETE, "'D'")
    kept = lambda x, initial: f"CASE WHEN kind < 2 THEN {plus(x, f'(kind + CASE WHEN initial = {initial!r} THEN 0 ELSE {turns.REROLE} END)', f'CASE WHEN initial = {initial!r} THEN {chr(39)}K{chr(39)} ELSE {chr(39)}R{chr(39)} END')} ELSE '~' END"
    system = f"CASE WHEN kind < 2 AND initial = 's' THEN {plus('s0', 'kind', chr(39) + 'K' + chr(39))} ELSE '~' END"
    user, other = f"least(s2, {plus('least(s0, s1, s3)', turns.INSERT, chr(39) + 'I' + chr(39))})", f"least(s3, {plus('u', turns.INSERT, chr(39) + 'I' + chr(39))})"
    never = f"{9 * 10**8}"
    return rf"""
WITH RECURSIVE m AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '.'), lambda c: ascii(c)::BIGINT)),
        lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS fault FROM conversations)
, d AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS n FROM m WHERE fault <> 0)
, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), n) AS place FROM d)
, f AS (SELECT conv_id, turn, role, text, place, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS prev,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE 'sound' END AS fault FROM o)
, t AS (SELECT *, CASE fault WHEN 'sound' THEN 0 WHEN 'truncated' THEN {turns.TRUNCATED} ELSE 2 END AS kind FROM f)
, fold AS (SELECT DISTINCT conv_id, 0::BIGINT AS seen, '000000000' AS s0, '{never}' AS s1, '{never}' AS s2, '{never}' AS s3 FROM t
    UNION ALL SELECT conv_id, place, {gone("s0")}, least({gone("s1")}, {system}), least({gone("u")}, {kept("least(s0, s1, v)", "u")}), least({gone("v")}, {kept("u", "a")})
    FROM (SELECT *, {other} AS v FROM (SELECT fold.*, t.place, t.initial, t.kind, {user} AS u FROM fold JOIN t ON t.conv_id IS NOT DISTINCT FROM fold.conv_id AND t.place = fold.seen + 1)))
, z AS (SELECT conv_id, least(s0, v) AS best FROM (SELECT *, {other} AS v FROM (SELECT *, {user} AS u FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seen DESC) AS back FROM fold) WHERE back = 1)))
, c AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (prev || initial NOT IN ('su', 'ua', 'au')) AS illegal, list({{'role': role, 'text': text}} ORDER BY place) AS said FROM t GROUP BY conv_id)
, e AS (SELECT z.conv_id, substr(best, 10) AS audit, left(best, 9)::BIGINT AS cost, c.* EXCLUDE (conv_id) FROM z JOIN c ON z.conv_id IS NOT DISTINCT FROM c.conv_id)
, g AS (SELECT *, length(audit) - length(ltrim(audit, 'D')) + 1 AS front FROM e)
, h AS (SELECT *, CASE WHEN audit[front] = 'K' AND left(said[front].role, 1) = 's' THEN 1 ELSE 0 END AS shift FROM g)
, r AS (SELECT *, array_to_string(list_filter(list_transform(range(1, length(audit) + 1), lambda i: CASE audit[i] WHEN 'D' THEN NULL WHEN 'K' THEN said[length(replace(audit[1:i], 'I', ''))].role
        ELSE CASE WHEN (length(replace(audit[1:i], 'D', '')) + shift) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN audit[i] = 'I' THEN '' ELSE said[length(replace(audit[1:i], 'I', ''))].text END), lambda x: x IS NOT NULL), chr(10)) AS repaired FROM h)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
    coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN r ON a.conv_id IS NOT DISTINCT FROM r.conv_id"""


_OP13 = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
, w AS MATERIALIZED (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d)
, k AS MATERIALIZED (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= {divergence.LEAST_DOCS})
, c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL)
, g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d)
, v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang)
, ns AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL)
, nl AS (SELECT lang, sum(n) AS total FROM c GROUP BY ALL)
, q AS (SELECT c.lang, c.term, 1 + (1000000000::HUGEINT * (sum(c.n) + {divergence.ADDED})) // (any_value(nl.total) + {divergence.ADDED} * any_value(v.v)) AS q FROM c JOIN nl USING (lang) JOIN v USING (lang) GROUP BY ALL)
, p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + {divergence.ADDED})) // (coalesce(ns.total, 0) + {divergence.ADDED} * v.v))::BIGINT AS p
    FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN ns USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term)
, s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL)
, x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL SELECT p.lang, p.source, 'term', p.term, (p.p - q.q)::BIGINT FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM x) WHERE part = 'pair' OR rank <= {divergence.REPORTED}"""


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": _mixing_sql(), "op4_minhash_near_dedup": _OP4, "op5_norm_sorted_topk": _OP5, "op6_exact_dedup": _OP6, "op11_conversation_repair": _repair_sql(), "op13_source_divergence": _OP13}
