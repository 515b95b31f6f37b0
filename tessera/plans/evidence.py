"""Queries of evidence and findings operators over the supplied tables, and their SQL.

The tables hold no repository.  Documents stand for files and their source for the module; orders
stand for commits and the parts of an order for the files it changes.  Rules that the tables have no
data for run over the small tables of `inline`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import text as T
from tessera.operators import clones, findings as P, graph, history, packing, rates, recall as R
from tessera.plans import inline as I
from tessera.session import materialize, spread, table
from tessera.runner import notes
from tessera.sources import definitions, repository, state

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(p for p in parts if p) + "\n"


def _fp_sql(name: str, of: str, key: str) -> str:
    """Winnowed fingerprints of a table, by windows over its tokens."""
    return f"""{name}_a AS (SELECT {key}, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS a FROM {of}),
{name}_t AS (SELECT {key}, len(a) AS n_tokens, unnest(a) AS w, generate_subscripts(a, 1) AS i FROM {name}_a),
{name}_s AS (SELECT {key}, n_tokens, i, lead(w, 4) OVER o AS w5, md5(w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o) || lpad(i::VARCHAR, 10, '0') AS h FROM {name}_t WINDOW o AS (PARTITION BY {key} ORDER BY i)),
{name}_m AS (SELECT {key}, n_tokens, min(h) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS h, lead(i, 3) OVER (PARTITION BY {key} ORDER BY i) AS last FROM {name}_s WHERE w5 IS NOT NULL),
{name} AS (SELECT DISTINCT {key}, n_tokens, substr(h, 1, 32) AS fp, substr(h, 33, 10)::INT - 1 AS pos FROM {name}_m WHERE last IS NOT NULL)"""


FP = _fp_sql("fp", "documents", "doc_id")
COPIED = """shared AS (SELECT fp FROM fp GROUP BY fp HAVING count(DISTINCT doc_id) >= 2),
cov AS (SELECT doc_id, least(5, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) - pos, 5)) AS n FROM fp WHERE fp IN (SELECT fp FROM shared)),
copied AS (SELECT doc_id, sum(n)::BIGINT AS copied FROM cov GROUP BY doc_id)"""
CAP_SQL = "CASE WHEN {0} >= 0.20 THEN 'D' WHEN {0} >= 0.10 THEN 'C' WHEN {0} >= 0.05 THEN 'B' ELSE 'A' END"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, written once for queries that read them several times."""
    return materialize(_winnowed(spark, sf_dir, wide=False).select("doc_id", "pos", "fp"), "fingerprints")


def _winnowed(spark: SparkSession, sf_dir: str, wide: bool = True) -> DataFrame:
    return clones.winnow(spread(_documents(spark, sf_dir).select("doc_id", "text")), wide=wide)


@query(_with(FP) + "SELECT doc_id, fp, pos FROM fp")
def winnow_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _winnowed(spark, sf_dir).select("doc_id", "fp", "pos")


SETS = """sets AS (SELECT DISTINCT doc_id, fp FROM fp),
whole AS (SELECT doc_id, count(*) AS n, md5(string_agg(fp, '' ORDER BY fp)) AS s FROM sets GROUP BY doc_id),
classes AS (SELECT min(doc_id) AS doc_id, n, s FROM whole GROUP BY n, s)"""


@query(_with(FP, SETS) + """, c AS (SELECT doc_id, n, fp FROM classes JOIN sets USING (doc_id)),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS n_a, y.n AS n_b, count(*) AS shared FROM c x JOIN c y ON x.fp = y.fp AND x.doc_id < y.doc_id GROUP BY ALL)
SELECT a, b, shared, round(shared / (n_a + n_b - shared), 6) AS similarity FROM p WHERE shared / (n_a + n_b - shared) >= 0.8""")  # fmt: skip
def clone_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clones.similar_pairs(_winnowed(spark, sf_dir, wide=False), "doc_id")[0]


@query(_with(FP, SETS) + "SELECT w.doc_id, c.doc_id AS class FROM whole w JOIN classes c USING (n, s)")
def clone_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clones.similar_classes(_winnowed(spark, sf_dir, wide=False), "doc_id")


SHINGLES = """ta AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS a FROM documents),
fp AS (SELECT DISTINCT doc_id, md5(w) AS fp FROM (SELECT doc_id, unnest(CASE WHEN len(a) < 5 THEN [array_to_string(a, ' ')] ELSE list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' ')) END) AS w FROM ta))"""


def _shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clones.shingle_rows(spread(_documents(spark, sf_dir).select("doc_id", "text")))


@query(_with(SHINGLES, SETS) + """, c AS (SELECT doc_id, n, fp FROM classes JOIN sets USING (doc_id)),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS n_a, y.n AS n_b, count(*) AS shared FROM c x JOIN c y ON x.fp = y.fp AND x.doc_id < y.doc_id GROUP BY ALL)
SELECT a, b, shared, round(shared / (n_a + n_b - shared), 6) AS similarity FROM p WHERE shared / (n_a + n_b - shared) >= 0.8""")  # fmt: skip
def near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of classes by all five-token shingles; `clone_pairs` goes by winnowed ones."""
    return clones.similar_pairs(_shingles(spark, sf_dir), "doc_id")[0]


@query(_with(SHINGLES, SETS) + "SELECT w.doc_id, c.doc_id AS class FROM whole w JOIN classes c USING (n, s)")
def near_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document, however short."""
    return clones.similar_classes(_shingles(spark, sf_dir), "doc_id")


@query(_with(FP, _fp_sql("bp", "benchmark", "item_id")) + """, w AS (SELECT DISTINCT item_id, fp FROM bp), z AS (SELECT item_id, count(*) AS n FROM w GROUP BY item_id),
m AS (SELECT item_id, doc_id, count(*) AS shared FROM (SELECT DISTINCT doc_id, fp FROM fp) JOIN w USING (fp) GROUP BY ALL)
SELECT item_id, doc_id, shared, round(shared / n, 6) AS share FROM m JOIN z USING (item_id) WHERE shared >= 0.5 * n""")  # fmt: skip
def benchmark_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = clones.winnow(table(spark, sf_dir, "benchmark"), "item_id", wide=False)
    return clones.contained(_winnowed(spark, sf_dir, wide=False), "doc_id", items, "item_id")


def _copied_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    copied = clones.copied_tokens(_fingerprints(spark, sf_dir), "doc_id")
    sizes = docs.select("doc_id", "source", F.size(T.tokens(F.col("text"))).cast("long").alias("tokens"))
    sums = sizes.join(copied, "doc_id", "left").groupBy("source").agg(F.sum("tokens").alias("tokens"), F.coalesce(F.sum("copied"), F.lit(0)).alias("copied"))
    return sums.withColumn("copied_share", F.round(F.coalesce(F.try_divide("copied", "tokens"), F.lit(0.0)), 6))


SHARE = f"""{COPIED},
share AS (SELECT source, sum(len(a))::BIGINT AS tokens, coalesce(sum(copied), 0)::BIGINT AS copied, round(coalesce(coalesce(sum(copied), 0) / nullif(sum(len(a)), 0), 0), 6) AS copied_share
FROM documents d JOIN fp_a USING (doc_id) LEFT JOIN copied USING (doc_id) GROUP BY source)"""


@query(_with(FP, SHARE) + f"SELECT source, tokens, copied, copied_share, {CAP_SQL.format('copied_share')} AS cap FROM share")
def copied_share_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _copied_share(spark, sf_dir)
    return rows.withColumn("cap", P.letter(P.copied_grade(F.col("copied_share"))))


@query(_with(FP) + "SELECT fp, count(DISTINCT doc_id) AS copies FROM fp GROUP BY fp HAVING count(DISTINCT doc_id) >= 3")
def rule_of_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = clones.shared_fingerprints(_winnowed(spark, sf_dir), "doc_id", 2)
    return P.rule_of_three(copies, copies.limit(0))


@query(_with(I.BLOCKS.sql, I.LOCKSTEP.sql) + "SELECT fp, copies FROM blocks WHERE copies >= 3 OR fp IN (SELECT fp FROM lockstep)")
def lockstep_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both halves of the rule: three copies, or fewer that must change together."""
    return P.rule_of_three(I.BLOCKS.df(spark), I.LOCKSTEP.df(spark))


@query(_with(FP) + """, s AS (SELECT DISTINCT source, fp FROM fp JOIN documents USING (doc_id)), z AS (SELECT source, count(*) AS n FROM s GROUP BY source),
p AS (SELECT x.source AS a, y.source AS b, count(*) AS shared FROM s x JOIN s y ON x.fp = y.fp AND x.source < y.source GROUP BY ALL)
SELECT a, b, shared, round(shared / least(u.n, v.n), 6) AS share FROM p JOIN z u ON u.source = a JOIN z v ON v.source = b WHERE round(shared / least(u.n, v.n), 6) >= 0.01""")  # fmt: skip
def parallel_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    sets = clones.fingerprint_rows(spread(docs.select("source", "text")), "source", F.lower("text"), wide=False)
    return clones.parallel_groups(materialize(sets.select("source", "fp").distinct(), "source-fingerprints"), "source", 0.01)


@query(_with(FP, COPIED) + "SELECT doc_id, copied FROM copied ORDER BY copied DESC, doc_id LIMIT 20")
def largest_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clones.routed(clones.copied_tokens(_fingerprints(spark, sf_dir), "doc_id"), _documents(spark, sf_dir), "doc_id", "source", largest=20)[1]


@query(_with(FP, COPIED) + "SELECT source, doc_id, copied FROM (SELECT source, doc_id, copied, row_number() OVER (PARTITION BY source ORDER BY copied DESC, doc_id) AS n FROM copied JOIN documents USING (doc_id)) WHERE n <= 3")
def copies_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-three report for each source."""
    return clones.routed(clones.copied_tokens(_fingerprints(spark, sf_dir), "doc_id"), _documents(spark, sf_dir), "doc_id", "source", per_module=3)[0]


@query(r"""SELECT doc_id, length(text) AS chars, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END AS lines,
len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM documents""")
def file_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir)
    return rows.select("doc_id", F.length("text").cast("long").alias("chars"), T.line_count(F.col("text")).alias("lines"), T.matches(F.col("text"), r"[^\x20\x09-\x0D]+").alias("words"))


HABITS = {"links": "https?://", "license": "(?i)licen[sc]e|rights reserved", "mail": "[a-z0-9.]+@[a-z0-9.]+", "shouting": "!!", "bars": r" \| ", "symbols": r"[*#$%&]{3}"}
_HABIT_SQL = ", ".join(f"len(regexp_extract_all(text, '{p}')) AS {k}" for k, p in HABITS.items())
HABITS_SQL = rf"""c AS (SELECT source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, {_HABIT_SQL} FROM documents),
s AS (SELECT source, sum(words)::BIGINT AS size, {", ".join(f"sum({k})::BIGINT AS {k}" for k in HABITS)} FROM c GROUP BY source)"""


def _habits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(_documents(spark, sf_dir).select("source", "text")).withColumn("words", T.matches(F.col("text"), r"[^\x20\x09-\x0D]+"))
    return rates.counted(docs, HABITS).select("source", "words", *HABITS)


@query(_with(HABITS_SQL) + "SELECT source, size, " + ", ".join(f"round(coalesce({k} * 1000 / nullif(size, 0), 0), 6) AS {k}_rate" for k in HABITS) + " FROM s")
def source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.module_rates(_habits(spark, sf_dir), "source", list(HABITS), "words")


FLAGS_SQL = HABITS_SQL + """, u AS (UNPIVOT (SELECT * FROM s) ON """ + ", ".join(HABITS) + """ INTO NAME counter VALUE n),
w AS (SELECT counter, sum(n) AS n_all, sum(size) AS size_all FROM u GROUP BY counter),
flags AS (SELECT source, counter, round(n * 1000 / size, 6) AS rate, round(n_all * 1000 / size_all, 6) AS whole FROM u JOIN w USING (counter) WHERE n_all > 0 AND size > 0 AND n * size_all >= 1.1 * n_all * size)"""


@query(_with(FLAGS_SQL) + "SELECT * FROM flags")
def rate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At 1.1 times the whole, since the supplied sources are nearly alike; the rule's own factor is two."""
    return rates.rate_flags(_habits(spark, sf_dir), "source", list(HABITS), "words", times=1.1)


@query(_with(FLAGS_SQL) + "SELECT 'HABIT-' || substr(md5(source || chr(1) || counter), 1, 8) AS id, source AS path, 'habit-' || counter AS category, 'medium' AS severity FROM flags")
def habit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.habit_findings(rate_flags(spark, sf_dir), "source").drop("cost")


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    rows = orders.select(F.col("o_orderkey").alias("commit_id"), F.col("o_orderdate").alias("ts"))
    return rows.join(lines.select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("path")), "commit_id")


COMMITS = "commits AS (SELECT o_orderkey AS commit_id, o_orderdate AS ts, l_partkey AS path FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
CHURN = "churn AS (SELECT path, count(DISTINCT commit_id) AS commits FROM commits WHERE ts >= (SELECT max(ts) FROM commits) - INTERVAL 365 DAY GROUP BY path)"
AGE = "age AS (SELECT path, CASE WHEN min(ts) >= (SELECT max(ts) FROM commits) - INTERVAL 365 DAY THEN date_diff('day', min(ts), (SELECT max(ts) FROM commits)) END AS age_days FROM commits GROUP BY path)"


@query(_with(COMMITS, CHURN) + "SELECT * FROM churn")
def churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.churn(_commits(spark, sf_dir))


@query(_with(COMMITS, AGE) + "SELECT * FROM age")
def file_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.file_age(_commits(spark, sf_dir))


@query(_with(COMMITS) + """SELECT count(DISTINCT commit_id) AS commits, min(ts) AS first, max(ts) AS last, date_diff('day', min(ts), max(ts)) AS days, count(DISTINCT commit_id) < 50 OR date_diff('day', min(ts), max(ts)) < 30 AS young FROM commits""")
def repo_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = _commits(spark, sf_dir)
    return history.repo_age(commits).crossJoin(history.is_young(commits))


@query(_with(COMMITS) + """, c AS (SELECT DISTINCT commit_id, path FROM commits) SELECT x.path AS a, y.path AS b, count(*) AS together FROM c x JOIN c y ON x.commit_id = y.commit_id AND x.path < y.path
WHERE (SELECT count(DISTINCT commit_id) >= 50 AND date_diff('day', min(ts), max(ts)) >= 30 FROM commits) GROUP BY ALL HAVING count(*) >= 2""")
def co_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.co_change(_commits(spark, sf_dir))


EDGES = "edges AS (SELECT DISTINCT path AS src, min(path) OVER (PARTITION BY commit_id) AS dst FROM commits)"


def _edges(commits: DataFrame) -> DataFrame:
    """Each part of an order depends on the order's least part."""
    least = commits.groupBy("commit_id").agg(F.min("path").alias("dst"))
    return commits.join(least, "commit_id").select(F.col("path").alias("src"), "dst").distinct()


FAN_IN = "fan_in AS (SELECT dst, count(DISTINCT src) AS fan_in FROM edges GROUP BY dst)"


@query(_with(COMMITS, EDGES, FAN_IN) + "SELECT * FROM fan_in")
def fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.fan_in(_edges(_commits(spark, sf_dir)))


@query(_with(I.FILES.sql, I.IMPORTS.sql) + """, h AS (SELECT regexp_extract(path, '^(.*)\\.[^./]*$', 1) AS stem, path FROM files), p AS (SELECT c.path AS impl, h.path AS header FROM h c JOIN h USING (stem) WHERE regexp_matches(c.path, '\\.(c|cc|cpp|cxx)$') AND regexp_matches(h.path, '\\.(h|hh|hpp|hxx)$')),
e AS (SELECT src, dst FROM imports UNION SELECT src, impl FROM imports JOIN p ON dst = header WHERE src <> impl) SELECT dst, count(*) AS fan_in FROM e GROUP BY dst""".replace("\\\\", "\\"))
def header_fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.fan_in(graph.with_header_importers(I.IMPORTS.df(spark), I.FILES.df(spark)))


CLOSURE = "tc AS (SELECT src, dst FROM imports UNION SELECT tc.src, i.dst FROM tc JOIN imports i ON tc.dst = i.src)"


@query(_with(I.IMPORTS.sql, CLOSURE) + "SELECT x.src AS node, min(least(x.src, y.src)) AS cycle FROM tc x JOIN tc y ON x.src = y.dst AND x.dst = y.src GROUP BY x.src")
def import_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycles(I.IMPORTS.df(spark))


REACH = """r AS (SELECT kind, path AS node FROM roots WHERE kind IN ('launched', 'manual', 'tests') UNION SELECT r.kind, i.dst FROM r JOIN imports i ON r.node = i.src)"""


@query(_with(I.FILES.sql, I.IMPORTS.sql, I.ROOTS.sql, REACH) + """SELECT path, CASE WHEN lang NOT IN ('python', 'javascript', 'typescript') THEN NULL WHEN bool_or(kind = 'launched') THEN 'launched' WHEN bool_or(kind = 'manual') THEN 'manual' WHEN bool_or(kind = 'tests') THEN 'tests' ELSE 'none' END AS reach
FROM files LEFT JOIN r ON path = node GROUP BY path, lang""")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reach_labels(I.FILES.df(spark), I.IMPORTS.df(spark), I.ROOTS.df(spark))


CLUSTERS = """l AS (SELECT file, a, b FROM links UNION SELECT file, b, a FROM links), tcl AS (SELECT file, name AS a, name AS b FROM definitions UNION SELECT tcl.file, tcl.a, l.b FROM tcl JOIN l ON tcl.file = l.file AND tcl.b = l.a),
clusters AS (SELECT file, a AS name, min(b) AS cluster FROM tcl GROUP BY file, a)"""


@query(_with(I.DEFINITIONS.sql, I.LINKS.sql, CLUSTERS) + "SELECT * FROM clusters")
def definition_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.clusters(I.DEFINITIONS.df(spark), I.LINKS.df(spark))


@query(_with(I.DEFINITIONS.sql, I.LINKS.sql, I.CALLS.sql, CLUSTERS) + """, c AS (SELECT DISTINCT file, cluster, caller FROM clusters JOIN calls USING (file, name)), k AS (SELECT DISTINCT file, cluster FROM c)
SELECT x.file, x.cluster AS a, y.cluster AS b, NOT EXISTS (SELECT 1 FROM c p JOIN c q ON p.file = q.file AND p.caller = q.caller WHERE p.file = x.file AND p.cluster = x.cluster AND q.cluster = y.cluster) AS seam FROM k x JOIN k y ON x.file = y.file AND x.cluster < y.cluster""")
def cluster_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.seams(graph.clusters(I.DEFINITIONS.df(spark), I.LINKS.df(spark)), I.CALLS.df(spark))


@query("SELECT source, doc_id, n_chars, ((sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) - n_chars) // 20000)::BIGINT AS shard FROM documents")
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.shards(_documents(spark, sf_dir), "source", "doc_id", "n_chars", 20_000)


GRADE_SQL = """, f AS (SELECT source, sum(CASE WHEN quality = 0 AND toxic = 1 THEN 10.0 WHEN quality = 0 THEN 3.0 ELSE 1.0 END) AS weighted, count(*) FILTER (quality = 0 AND toxic = 1) AS critical, count(*) FILTER (quality = 0 AND toxic = 0) AS high FROM labels JOIN documents USING (doc_id) WHERE quality = 0 OR toxic = 1 GROUP BY source),
g AS (SELECT s.source, coalesce(weighted, 0)::DOUBLE AS weighted, tokens AS loc, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, copied_share, round(coalesce(coalesce(weighted, 0) * 1000 / nullif(tokens, 0), 0), 6) AS idx FROM share s LEFT JOIN f USING (source))"""
RANKS = """SELECT *, greatest(i, s, c) AS worst FROM (SELECT *, CASE WHEN idx < 1 THEN 0 WHEN idx < 2 THEN 1 WHEN idx < 4 THEN 2 WHEN idx < 8 THEN 3 ELSE 4 END AS i, greatest(CASE WHEN critical >= 1 THEN 2 ELSE 0 END, CASE WHEN high >= 10 THEN 2 WHEN high >= 5 THEN 1 ELSE 0 END) AS s,
CASE WHEN copied_share >= 0.20 THEN 3 WHEN copied_share >= 0.10 THEN 2 WHEN copied_share >= 0.05 THEN 1 ELSE 0 END AS c FROM {})"""
GRADED = "SELECT {}, weighted, loc, critical, high, copied_share, idx, ['A', 'B', 'C', 'D', 'F'][worst + 1] AS grade, CASE WHEN i = worst THEN 'index' WHEN s = worst THEN 'serious' ELSE 'copied' END AS gate FROM ({})"


@query(_with(FP, SHARE) + GRADE_SQL + GRADED.format("source", RANKS.format("g")))
def grade_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled junk as high findings, toxic junk as critical, other toxic documents as medium; tokens as lines."""
    labels, docs = table(spark, sf_dir, "labels"), _documents(spark, sf_dir).select("doc_id", "source")
    severity = F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "critical").when(F.col("quality") == 0, "high").otherwise("medium")
    found = labels.where("quality = 0 OR toxic = 1").join(docs, "doc_id").select("source", severity.alias("severity"), F.lit("kept").alias("status"))
    share = _copied_share(spark, sf_dir).select("source", F.col("tokens").alias("loc"), "copied_share")
    rows = share.join(P.weighed(found, ["source"]), "source", "left")
    rows = rows.select("source", F.coalesce("weighted", F.lit(0.0)).alias("weighted"), "loc", F.coalesce("critical", F.lit(0)).alias("critical"), F.coalesce("high", F.lit(0)).alias("high"), "copied_share")
    return P.graded(rows)


@query(_with(I.SCORES.sql) + ", g AS (SELECT *, round(coalesce(weighted * 1000 / nullif(loc, 0), 0), 6) AS idx FROM scores) " + GRADED.format("name", RANKS.format("g")))
def grade_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.graded(I.SCORES.df(spark))


@query(_with(COMMITS, CHURN, AGE, EDGES, FAN_IN) + """, f AS (SELECT 'PART-' || p_partkey AS id, p_partkey AS path, CASE WHEN p_size % 25 = 0 THEN 'parallel-implementations' ELSE 'coupling' END AS category, CASE WHEN p_size >= 45 THEN 'high' WHEN p_size >= 40 THEN 'medium' ELSE 'low' END AS severity FROM part WHERE p_size >= 35)
SELECT id, path, severity, (coalesce(commits, 0) + coalesce(fan_in, 0) + CASE WHEN age_days IS NOT NULL THEN coalesce(fan_in, 0) ELSE 0 END)::BIGINT AS priority FROM f LEFT JOIN churn USING (path) LEFT JOIN age USING (path) LEFT JOIN fan_in ON dst = f.path
ORDER BY category = 'parallel-implementations' DESC, priority DESC, CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, id LIMIT 10""")
def fix_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large parts as findings; a top-ten report."""
    part, commits = table(spark, sf_dir, "part"), materialize(_commits(spark, sf_dir), "commits")
    category = F.when(F.col("p_size") % 25 == 0, "parallel-implementations").otherwise("coupling")
    severity = F.when(F.col("p_size") >= 45, "high").when(F.col("p_size") >= 40, "medium").otherwise("low")
    found = part.where("p_size >= 35").select(F.concat(F.lit("PART-"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_partkey").alias("path"), category.alias("category"), severity.alias("severity"))
    traffic = history.file_age(commits).join(history.churn(commits), "path", "left")
    traffic = traffic.join(graph.fan_in(_edges(commits)).withColumnRenamed("dst", "path"), "path", "left")
    return P.fix_first(found, traffic)


TIER = "CASE tier WHEN 'editor' THEN 1 WHEN 'appeal' THEN 2 WHEN 'chief' THEN 3 ELSE 0 END"
LAST = f"last AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY {TIER} DESC, action, reason) AS n FROM decisions) WHERE n = 1)"
DECIDED = """decided AS (SELECT f.* EXCLUDE (severity), CASE WHEN action = 'rerate' THEN coalesce(new_severity, severity) ELSE severity END AS severity, CASE action WHEN 'drop' THEN 'dropped' WHEN 'merge' THEN 'merged' ELSE 'kept' END AS status, merged_into, reason FROM findings f LEFT JOIN last ON id = finding_id)"""


@query(_with(I.FINDINGS.sql, I.DECISIONS.sql, LAST, DECIDED) + "SELECT id, severity, effort, status, merged_into, reason FROM decided")
def latest_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.apply_decisions(I.FINDINGS.df(spark), I.DECISIONS.df(spark)).select("id", "severity", "effort", "status", "merged_into", "reason")


RANK = "CASE {} WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 END"
VALID = "valid AS (SELECT * FROM findings WHERE path IS NOT NULL AND severity IN ('low', 'medium', 'high', 'critical') AND trim(coalesce(cost, '')) <> '' AND category <> 'size')"


@query(_with(I.FINDINGS.sql, VALID) + f"SELECT id, path, category, severity, merged FROM (SELECT *, count(*) OVER k AS merged, row_number() OVER (PARTITION BY path, category, line_lo, line_hi ORDER BY {RANK.format('severity')} DESC, id) AS n FROM valid WINDOW k AS (PARTITION BY path, category, line_lo, line_hi)) WHERE n = 1")
def merged_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.merge(P.valid(I.FINDINGS.df(spark))).select("id", "path", "category", "severity", "merged")


@query(_with(I.FINDINGS.sql, I.FILES.sql) + f"""SELECT id, CASE WHEN is_test OR is_script THEN CASE severity WHEN 'critical' THEN 'high' WHEN 'high' THEN 'medium' ELSE 'low' END ELSE severity END AS severity FROM findings f LEFT JOIN files USING (path) WHERE NOT coalesce(is_test OR is_script, false) OR {RANK.format('severity')} > 1""")
def lower_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.lower_bar(I.FINDINGS.df(spark), I.FILES.df(spark)).select("id", "severity")


@query(_with(I.FINDINGS.sql, I.DECISIONS.sql) + f"""SELECT id, severity, action, reason FROM findings JOIN decisions ON id = finding_id AND tier = 'editor' WHERE {RANK.format('severity')} >= 2 AND (action = 'drop' OR action = 'rerate' AND {RANK.format('new_severity')} < {RANK.format('severity')})""")
def appeals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.to_appeal(I.FINDINGS.df(spark), I.DECISIONS.df(spark))


@query(_with(I.FINDINGS.sql) + "SELECT ((row_number() OVER (ORDER BY id) - 1) // 4)::BIGINT AS batch, id FROM findings")
def editor_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.batches(I.FINDINGS.df(spark), "id", 4)


@query(_with(I.FINDINGS.sql, I.DECISIONS.sql, I.EXPECTED.sql, LAST, DECIDED) + """, m AS (SELECT e.note, e.path, d.id, d.status, d.reason FROM expected e LEFT JOIN decided d ON (d.path = rtrim(e.path, '/') OR starts_with(d.path, rtrim(e.path, '/') || '/')) AND (e.category IS NULL OR e.category = d.category)
AND (e.lines IS NULL OR d.line_lo IS NULL OR d.line_lo <= e.lines[2] AND d.line_hi >= e.lines[1]) AND (e.keywords IS NULL OR len(e.keywords) = 0 OR len(list_filter(e.keywords, lambda k: contains(lower(d.text), lower(k)))) > 0)),
b AS (SELECT note, path, min(CASE WHEN status = 'kept' THEN 0 WHEN status IS NOT NULL THEN 1 ELSE 2 END) AS r, min(reason) FILTER (status <> 'kept') AS reason FROM m GROUP BY ALL)
SELECT note, path, ['kept', 'dismissed', 'never raised'][r + 1] AS answer, CASE WHEN r = 1 THEN reason END AS reason FROM b""")
def recall_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.recall(I.EXPECTED.df(spark), P.apply_decisions(I.FINDINGS.df(spark), I.DECISIONS.df(spark)))


@query(r"""WITH f AS (SELECT source || '/' || doc_id AS path, len(regexp_extract_all(text, '[*#$%&|!]')) * 20 > length(text) AS noisy FROM documents), d AS (SELECT path, CASE WHEN noisy THEN 'kept' ELSE 'dropped' END AS status FROM f WHERE noisy OR contains(path, '7'))
SELECT source || '/' || l.doc_id AS note, source || '/' || l.doc_id AS path, CASE status WHEN 'kept' THEN 'kept' WHEN 'dropped' THEN 'dismissed' ELSE 'never raised' END AS answer, CASE status WHEN 'dropped' THEN 'few symbols' END AS reason
FROM labels l JOIN documents USING (doc_id) LEFT JOIN d ON d.path = source || '/' || l.doc_id WHERE quality = 0""")
def recall_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled as junk are what is expected; documents full of symbols are what was found."""
    docs = _documents(spark, sf_dir)
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    noisy = T.matches(F.col("text"), r"[*#$%&|!]") * 20 > F.length("text")
    none = F.lit(None)
    found = docs.select(path.alias("path"), noisy.alias("noisy")).where(F.col("noisy") | F.contains("path", F.lit("7")))
    found = found.select("path", none.cast("int").alias("line_lo"), none.cast("int").alias("line_hi"), F.lit("noise").alias("category"), F.lit("").alias("text"), F.when(F.col("noisy"), "kept").otherwise("dropped").alias("status"), F.when(~F.col("noisy"), "few symbols").alias("reason"))
    expected = table(spark, sf_dir, "labels").where("quality = 0").join(docs.select("doc_id", "source"), "doc_id")
    expected = expected.select(path.alias("path"), none.cast("array<int>").alias("lines"), none.cast("string").alias("category"), path.alias("note"), none.cast("array<string>").alias("keywords"))
    return R.recall(expected, found)


@query(_with(I.TASKS.sql) + "SELECT tier, status, count(*) AS tasks FROM (SELECT tier, task_id, arg_max(status, attempt) AS status FROM tasks GROUP BY ALL) GROUP BY ALL")
def task_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.task_status(I.TASKS.df(spark))


@query(_with(I.TASKS.sql) + "SELECT DISTINCT tier, task_id FROM tasks WHERE task_id NOT IN (SELECT task_id FROM tasks WHERE status = 'done')")
def unfinished_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = I.TASKS.df(spark)
    return state.unfinished(tasks.select("tier", "task_id").distinct(), tasks)


@query("SELECT event_type AS tier, count(DISTINCT user_id) AS tasks, sum(event_id)::BIGINT AS tokens FROM events GROUP BY event_type")
def usage_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("tier"), F.col("user_id").alias("task_id"), F.col("event_id").alias("tokens"))
    return state.usage(events)


@query("SELECT conv_id, count(*) AS steps, string_agg(role, ' -> ' ORDER BY turn, role) AS trace FROM conversations GROUP BY conv_id")
def flow_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.sort_array(F.collect_list(F.struct("turn", "role")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("steps"), F.array_join(F.transform(steps, lambda s: s["role"]), " -> ").alias("trace"))


@query(_with(I.FILES.sql) + "SELECT path FROM files WHERE NOT is_test AND NOT starts_with(path, 'legacy/')")
def scanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.without_tests(repository.excluding(I.FILES.df(spark), "legacy/**")).select("path")


@query(_with(I.CODE.sql) + r"""SELECT path, len(regexp_extract_all(text, 'except[^:\n]*:\s*pass\b|catch\s*(\([^)]*\))?\s*\{\s*\}')) AS swallowed_catches, len(regexp_extract_all(text, 'except\s*:|except\s+(Base)?Exception\b|catch\s*\(\s*(\.\.\.|Exception|Throwable)')) AS broad_catches,
len(regexp_extract_all(text, '\b(log|logger|logging|console)\.\w+\s*\(')) AS logging_calls, len(regexp_extract_all(text, '(?i)fallback|best[- _]effort')) AS fallback_mentions FROM code""")
def habit_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.counted(I.CODE.df(spark), T.COUNTERS).drop("text")


@query(_with(I.CODE.sql) + r""", l AS (SELECT path, unnest(string_split(text, chr(10))) AS code, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM code), n AS (SELECT *, lead(code) OVER (PARTITION BY path ORDER BY line) AS next FROM l),
w AS (SELECT path, line, list_distinct(regexp_extract_all(lower(code), '[a-z]{2,}')) AS a, regexp_extract_all(lower(next), '[a-z]{2,}') AS b FROM n WHERE regexp_matches(code, '^\s*(#|//)') AND next IS NOT NULL)
SELECT path, line FROM w WHERE len(a) > 0 AND len(list_intersect(a, b)) / len(a) >= 0.6""")
def restated_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.restated_comments(I.CODE.df(spark))


@query(_with(I.RAW_IMPORTS.sql, I.ALIASES.sql) + """, m AS (SELECT src, raw, target || substr(raw, length(prefix) + 1) AS target, row_number() OVER (PARTITION BY src, raw ORDER BY length(scope) DESC, length(prefix) DESC, target DESC) AS n FROM raw_imports JOIN aliases ON starts_with(raw, prefix) AND (scope = '' OR starts_with(src, scope || '/')))
SELECT r.src, r.raw, m.target FROM raw_imports r LEFT JOIN m ON r.src = m.src AND r.raw = m.raw AND n = 1""")
def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.resolve_aliases(I.RAW_IMPORTS.df(spark), I.ALIASES.df(spark))


@query(_with(I.DOCUMENTED.sql, I.ROOTS.sql) + "SELECT coalesce(d.path, r.path) AS path, CASE WHEN r.path IS NULL THEN 'documented only' ELSE 'launched only' END AS side FROM documented d FULL JOIN (SELECT path FROM roots WHERE kind = 'launched') r ON d.path = r.path WHERE d.path IS NULL OR r.path IS NULL")
def documented_or_launched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.documented_and_launched(I.DOCUMENTED.df(spark), I.ROOTS.df(spark).where("kind = 'launched'"))


@query(_with(I.EVIDENCE.sql) + ", r AS (SELECT *, list_position(['reason_to_change', 'co_change', 'static_structure'], kind) AS r FROM evidence) SELECT a, b, kind, bool_and(together) AS together FROM r WHERE r = (SELECT min(r) FROM r x WHERE x.a = r.a AND x.b = r.b) GROUP BY ALL")
def strongest_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.strongest_evidence(I.EVIDENCE.df(spark))


@query(_with(I.RUNS.sql) + "SELECT tier, status, count(*) AS tasks FROM (SELECT tier, task_id, status, row_number() OVER (PARTITION BY tier, task_id ORDER BY run DESC, attempt DESC) AS n FROM runs) WHERE n = 1 GROUP BY ALL")
def resumed_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.task_status(I.RUNS.df(spark))


@query(_with(I.RUNS.sql) + "SELECT tier, task_id FROM runs GROUP BY ALL HAVING arg_max(status, run) = 'skipped'")
def gaps_after_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.gaps(I.RUNS.df(spark)).select("tier", "task_id")


_OBJECT = r"(SELECT task_id, CASE WHEN contains(message, '{') THEN regexp_extract(message, '(?s)(\{.*\})', 1) END AS j FROM answers)"


@query(_with(I.ANSWERS.sql) + f"""SELECT task_id, d->>'finding_id' AS finding_id, d->>'action' AS action, d->>'new_severity' AS new_severity, d->>'reason' AS reason FROM (SELECT task_id, unnest(json_extract(j, '$.decisions[*]')) AS d FROM {_OBJECT})
WHERE d->>'finding_id' IS NOT NULL AND d->>'action' IN ('verify', 'merge', 'rerate', 'drop')""")
def answered_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.answered_decisions(I.ANSWERS.df(spark)).select("task_id", "finding_id", "action", "new_severity", "reason")


@query(_with(I.ANSWERS.sql) + f"""SELECT task_id, f->>'id' AS id, f->>'path' AS path, (f->>'line_lo')::INTEGER AS line_lo, f->>'severity' AS severity FROM (SELECT task_id, unnest(json_extract(j, '$.findings[*]')) AS f FROM {_OBJECT})
WHERE f->>'path' IS NOT NULL AND f->>'severity' IN ('low', 'medium', 'high', 'critical')""")
def answered_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.answered_findings(I.ANSWERS.df(spark)).select("task_id", "id", "path", "line_lo", "severity")


FUNCTIONS = r"""sl AS (SELECT path, unnest(string_split(text, chr(10))) AS code, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM sources), sk AS (SELECT *, length(code) - length(ltrim(code)) AS indent FROM sl WHERE trim(code) <> ''),
sd AS (SELECT path, regexp_extract(code, 'def\s+(\w+)', 1) AS name, line AS start, indent FROM sk WHERE regexp_matches(code, '^\s*def\s+\w+')),
functions AS (SELECT path, name, start, (SELECT max(line) FROM sk k WHERE k.path = sd.path AND k.line < coalesce((SELECT min(line) FROM sk z WHERE z.path = sd.path AND z.line > sd.start AND z.indent <= sd.indent), 1000000)) - start + 1 AS lines FROM sd)"""


@query(_with(I.SOURCES.sql, FUNCTIONS) + "SELECT path, name, start::BIGINT AS start, lines::BIGINT AS lines FROM functions")
def source_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return definitions.definitions(I.SOURCES.df(spark)).select("path", "name", "start", "lines")


_SIX = [*T.COUNTERS, "restated_comments", "long_functions"]
_COUNTS = ", ".join(f"len(regexp_extract_all(text, '{p}')) AS {k}" for k, p in (("swallowed_catches", r"except[^:\n]*:\s*pass\b"), ("broad_catches", r"except\s*:|except\s+(Base)?Exception\b"), ("logging_calls", r"\b(log|logger|logging|console)\.\w+\s*\("), ("fallback_mentions", "(?i)fallback|best[- _]effort")))
SIX = f"""{FUNCTIONS}, rn AS (SELECT *, lead(code) OVER (PARTITION BY path ORDER BY line) AS next FROM sl), rw AS (SELECT path, list_distinct(regexp_extract_all(lower(code), '[a-z]{{2,}}')) AS a, regexp_extract_all(lower(next), '[a-z]{{2,}}') AS b FROM rn WHERE regexp_matches(code, '^\\s*#') AND next IS NOT NULL),
rc AS (SELECT path, count(*) AS restated_comments FROM rw WHERE len(a) > 0 AND len(list_intersect(a, b)) / len(a) >= 0.6 GROUP BY path), lf AS (SELECT path, count(*) AS long_functions FROM functions WHERE lines > 2 GROUP BY path),
six AS (SELECT module, sum(loc)::BIGINT AS size, {", ".join(f"coalesce(sum({k}), 0) AS {k}" for k in _SIX)} FROM (SELECT module, loc, path, {_COUNTS} FROM sources) LEFT JOIN rc USING (path) LEFT JOIN lf USING (path) GROUP BY module)"""


@query(_with(I.SOURCES.sql, SIX) + "SELECT module, size, " + ", ".join(f"round(coalesce({k} * 1000 / nullif(size, 0), 0), 6) AS {k}_rate" for k in _SIX) + " FROM six")
def module_rates_six(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six habits; functions of more than two lines count as long, as the inline sources are short."""
    files = I.SOURCES.df(spark)
    each = lambda rows, name: rows.groupBy("path").agg(F.count("*").alias(name))
    counted = rates.counted(files, T.COUNTERS).join(each(rates.restated_comments(files), "restated_comments"), "path", "left")
    counted = counted.join(each(definitions.long_functions(definitions.definitions(files), 2), "long_functions"), "path", "left")
    return rates.module_rates(counted.fillna(0, _SIX), "module", _SIX, "loc")


@query(_with(I.FILES.sql, I.IMPORTS.sql, I.ROOTS.sql, REACH) + """, l AS (SELECT path, CASE WHEN lang NOT IN ('python', 'javascript', 'typescript') THEN NULL WHEN bool_or(kind = 'launched') THEN 'launched' WHEN bool_or(kind = 'manual') THEN 'manual' WHEN bool_or(kind = 'tests') THEN 'tests' ELSE 'none' END AS reach FROM files LEFT JOIN r ON path = node GROUP BY path, lang),
n AS (SELECT path AS subject, 'reach: ' || reach AS note FROM l WHERE reach IS NOT NULL UNION ALL SELECT dst, 'imported by ' || count(DISTINCT src) || ' files' FROM imports GROUP BY dst)
SELECT subject, string_agg(note, chr(10) ORDER BY note) AS notes FROM n GROUP BY subject""")
def prompt_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, edges = I.FILES.df(spark), I.IMPORTS.df(spark)
    return notes.by_file({"reach": graph.reach_labels(files, edges, I.ROOTS.df(spark)), "fan_in": graph.fan_in(edges)})


@query(_with(I.CODE.sql, I.FILES.sql) + r""", s AS (SELECT DISTINCT path AS src, unnest(regexp_extract_all(text, '[''"]([\w./-]{3,})[''"]', 1)) AS name FROM code), k AS (SELECT path AS dst, path AS name FROM files UNION SELECT path, replace(regexp_replace(path, '\.\w+$', ''), '/', '.') FROM files)
SELECT DISTINCT src, dst FROM s JOIN k USING (name) WHERE src <> dst""")
def loads_in_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.string_loads(I.CODE.df(spark), I.FILES.df(spark))


@query(_with(I.CODE.sql) + r""", l AS (SELECT path, unnest(string_split(text, chr(10))) AS code FROM code), p AS (SELECT path, regexp_extract(code, '^from\s+([.\w]+)', 1) AS base, regexp_extract(code, 'import\s+(\w+)', 1) AS name FROM l WHERE ends_with(path, '.py') AND regexp_matches(code, '^(from\s+\S+\s+)?import\s'))
SELECT path AS src, name AS raw FROM p WHERE base = '' UNION SELECT path, unnest([base, base || '.' || name]) FROM p WHERE base <> '' UNION SELECT path, unnest(regexp_extract_all(text, '(from|import)\s+[''"]([^''"]+)[''"]', 2)) FROM code WHERE ends_with(path, '.ts')
UNION SELECT path, unnest(regexp_extract_all(text, '#include [<"]([^>"]+)[>"]', 1)) FROM code WHERE ends_with(path, '.cpp')""")
def extracted_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = I.CODE.df(spark).withColumn("lang", repository.language(F.col("path")))
    return repository.imports(files).select("src", "raw")


@query(_with(I.CONFIGS.sql) + r""", c AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS scope, regexp_replace(regexp_replace(text, '("(\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', '\1', 'g'), ',(\s*[}\]])', '\1', 'g') AS j FROM configs WHERE regexp_matches(path, '[jt]sconfig[^/]*\.json$')), v AS (SELECT scope, CASE WHEN json_valid(j) THEN j END AS j FROM c),
k AS (SELECT scope, coalesce(j->'compilerOptions'->>'baseUrl', '.') AS base, j->'compilerOptions'->'paths' AS p, unnest(json_keys(j->'compilerOptions'->'paths')) AS key FROM v)
SELECT scope, rtrim(key, '*') AS prefix, regexp_replace(CASE WHEN scope = '' THEN '' ELSE scope || '/' END || base || '/' || rtrim(json_extract_string(p, '$."' || key || '"[0]'), '*'), '(^|/)(\./)+', '\1', 'g') AS target FROM k""")
def alias_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.aliases_of(I.CONFIGS.df(spark))


@query(_with(I.TREES.sql, I.CHANGES.sql) + r""", d AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS name FROM trees WHERE contains(path, '/')), t AS (SELECT *, regexp_extract(dir, '^(.*?)/?[^/]*$', 1) AS top FROM d),
p AS (SELECT x.dir AS dir_a, y.dir AS dir_b, count(*) AS shared_names FROM t x JOIN t y ON x.top = y.top AND x.name = y.name AND x.dir < y.dir GROUP BY ALL HAVING count(*) >= 2), c AS (SELECT DISTINCT commit_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM changes)
SELECT dir_a, dir_b, shared_names, (SELECT count(*) FROM c u JOIN c w USING (commit_id) WHERE u.dir = dir_a AND w.dir = dir_b) AS together FROM p""")
def parallel_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clones.parallel_trees(I.TREES.df(spark), I.CHANGES.df(spark))


@query(_with(I.PACKAGES.sql) + r""", f AS (SELECT path, text, regexp_extract(path, '^(.*?)/?[^/]*$', 1) AS d FROM packages), g AS (SELECT path, d, unnest(regexp_extract_all(text, '[''"](!?\.?/[^''"]+)[''"]', 1)) AS said FROM f WHERE contains(text, 'import.meta.glob')),
b AS (SELECT path, starts_with(said, '!') AS out, replace(CASE WHEN ltrim(said, '!')[1] = '/' THEN ltrim(said, '!')[2:] ELSE d || '/' || ltrim(said, '!') END, '/./', '/') AS g FROM g),
r AS (SELECT path, out, replace(replace(regexp_replace(replace(replace(replace(g, '.', '\.'), '{x,y}', '(x|y)'), '**/', '@'), '\*', '[^/]*', 'g'), '@', '(.*/)?'), '@', '') AS re FROM b), hits AS (SELECT r.path AS src, f.path AS dst, r.out FROM r JOIN f ON regexp_full_match(f.path, re))
SELECT x.path AS src, y.path AS dst FROM f x JOIN f y ON x.d = y.d AND x.path <> y.path WHERE regexp_matches(x.path, '/(__init__\.py|index\.[jt]sx?)$') AND regexp_matches(x.text, 'iter_modules|require\.context')
UNION SELECT src, dst FROM hits GROUP BY src, dst HAVING NOT bool_or(out) AND src <> dst""")
def loaded_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.package_edges(I.PACKAGES.df(spark))


@query(_with(I.DEPLOYED.sql) + r""", l AS (SELECT CASE WHEN path = 'Dockerfile' THEN 'container' WHEN path = 'Procfile' THEN 'procfile' WHEN ends_with(path, 'package.json') THEN 'package' ELSE 'docs' END AS "by", regexp_extract(path, '^(.*?)/?[^/]*$', 1) AS d, text FROM deployed WHERE NOT regexp_matches(path, '\.(py|cjs|tsx)$')),
s AS (SELECT "by", d, unnest(regexp_extract_all(text, '[\w./-]+\.(py|cjs|tsx)\b')) AS said FROM l UNION ALL SELECT "by", d, replace(unnest(regexp_extract_all(text, '([\w.]+):\w+', 1)), '.', '/') || '.py' FROM l), n AS (SELECT "by", unnest([regexp_replace(said, '^\./', ''), CASE WHEN d = '' THEN '' ELSE d || '/' END || regexp_replace(said, '^\./', '')]) AS path FROM s),
k AS (SELECT path, CASE WHEN "by" = 'docs' THEN 'docs' ELSE 'launched' END AS kind, "by" FROM n WHERE path IN (SELECT path FROM deployed) UNION SELECT path, 'tests', 'test runner' FROM deployed WHERE is_test UNION SELECT path, 'launched', 'django' FROM deployed WHERE path = 'app/wsgi.py')
SELECT * FROM k UNION SELECT path, 'manual', 'main guard' FROM deployed WHERE regexp_matches(coalesce(text, ''), '^#!|__name__ == .__main__.') AND path NOT IN (SELECT path FROM k WHERE kind <> 'docs')""")
def launched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.entry_points(I.DEPLOYED.df(spark))
