"""Queries of changes, slices and running values, of choices by built texts, and of joins by places and phrases."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from brevispark.functions import arrays as A
from brevispark.functions import text as T
from brevispark.operators import calibration as G
from brevispark.operators import compression as C
from brevispark.operators import evaluation as E
from brevispark.operators import incremental as I
from brevispark.operators import joins as J
from brevispark.operators import running as N
from brevispark.operators import sampling as M
from brevispark.operators import words as W
from brevispark.operators.cascade import Dependencies, Link
from brevispark.operators.slices import Ledger, in_slices
from brevispark.session import durable, scratch

from .relational import _SAMPLE, _TERCILES, PAIRS, _sample
from .study import STUDY, Catalogue, conditions, paired_sql, r6, rounded, spread, table
from .textual import _FLAT, KEPT, TOKS, keyed

CATALOGUE = Catalogue()

#: The warehouse as tables that depend on each other: line items on two ways.
WAREHOUSE = Dependencies(
    {"customer": ("c_custkey",), "part": ("p_partkey",), "orders": ("o_orderkey",), "lineitem": ("l_orderkey", "l_linenumber"), "events": ("event_id",)},
    [Link("orders", "customer", ("o_custkey",)), Link("lineitem", "orders", ("l_orderkey",)), Link("lineitem", "part", ("l_partkey",)), Link("events", "customer", ("user_id",))],
)


@CATALOGUE.add("""WITH c AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0), p AS (SELECT p_partkey FROM part WHERE p_size > 45), o AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM c))
SELECT 'orders' AS source, o_orderkey AS key, 0 AS part FROM o UNION ALL SELECT 'events', event_id, 0 FROM events WHERE user_id NOT IN (SELECT c_custkey FROM c)
UNION ALL SELECT 'lineitem', l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM p) AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))""")
def cascade_survivors(spark, sf_dir):
    """What is left when some customers and some parts change and all that depends on them goes."""
    tables = {name: table(spark, sf_dir, name) for name in WAREHOUSE.keys}
    left = WAREHOUSE.surviving(tables, {"customer": tables["customer"].where("c_acctbal < 0").select("c_custkey"), "part": tables["part"].where("p_size > 45").select("p_partkey")})
    rows = lambda name, key, part: left[name].select(F.lit(name).alias("source"), F.col(key).alias("key"), part.cast("int").alias("part"))
    return rows("orders", "o_orderkey", F.lit(0)).unionByName(rows("events", "event_id", F.lit(0))).unionByName(rows("lineitem", "l_orderkey", F.col("l_linenumber")))


class _Killed(Exception):
    """Stands for the death of a run."""


@CATALOGUE.add(f"""WITH {KEPT} SELECT d.doc_id, cast(coalesce(n, 0) AS integer) AS n_kept, sha256(coalesce(t, '')) AS text_sha256 FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(form, ' ' ORDER BY pos) AS t FROM kept WHERE rho = 0.5 AND lives GROUP BY 1) k USING (doc_id)""")
def sliced_compression(spark, sf_dir):
    """Half of each document's words, compressed in slices by a run that dies after three of them and one that goes on."""
    at = f"{scratch(spark)}/sliced-{uuid.uuid4().hex}"
    ledger, docs = Ledger(spark, f"{at}/ledger"), table(spark, sf_dir, "documents").select("doc_id", "text")
    each = max(1, -(-docs.count() // 8))
    stored: list = []

    def step(limit):
        def run(rows):
            if limit is not None and len(calls) >= limit:
                raise _Killed
            calls.append(1)
            rows = spread(rows).select("doc_id", T.tokens(F.col("text")).alias("forms")).select("doc_id", "forms", C.marks(F.col("forms")).alias("marks"))
            return rows.select("doc_id", F.array_join(C.kept_by_marks(F.col("forms"), F.col("marks"), (0.5,))[0]["kept"], " ").alias("kept"))

        calls: list = []
        return run

    def store(rows):
        """Appended, and read by key: rows that are stored twice count once."""
        rows.write.mode("append").parquet(f"{at}/kept")
        stored.append(1)

    def open_():
        return docs.join(spark.read.parquet(f"{at}/kept").select("doc_id"), "doc_id", "left_anti") if stored else docs

    try:
        in_slices(ledger, open_, ["doc_id"], step(3), store, each)
    except _Killed:
        pass
    in_slices(ledger, open_, ["doc_id"], step(None), store, each)
    found = spark.read.parquet(f"{at}/kept").dropDuplicates(["doc_id"])
    return found.select("doc_id", T.ws_count(F.coalesce("kept", F.lit(""))).cast("int").alias("n_kept"), F.sha2(F.coalesce("kept", F.lit("")), 256).alias("text_sha256"))


_UNITS = 6
_WORDS = lambda x: f"len(regexp_extract_all({x}, '[^{T.SPACE}]+'))"


@CATALOGUE.add(f"""WITH t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations), c AS (SELECT conv_id, max(text) FILTER (WHERE r = 1) AS base, coalesce(list(text ORDER BY r) FILTER (WHERE r > 1), []) AS u FROM t WHERE r <= {_UNITS + 1} GROUP BY 1),
b AS (SELECT *, {_WORDS('base')} AS n_base, list_transform(u, lambda x: {_WORDS('x')}) AS sizes FROM c), m AS (SELECT b.*, list_filter(range(0, {_UNITS}), lambda i: (k >> i) & 1 = 1) AS units FROM b, (SELECT unnest(range(1, {1 << _UNITS})) AS k) WHERE k < 1 << len(u) AND n_base > 0),
few AS (SELECT *, list_sum(list_transform(units, lambda i: sizes[i + 1])) AS total FROM m QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY abs(total - 0.5 * n_base), len(units), units) <= 4),
built AS (SELECT *, {_WORDS("base || array_to_string(list_transform(units, lambda i: u[i + 1]), '')")} AS n FROM few)
SELECT conv_id, cast(n_base AS bigint) AS n_base, array_to_string(units, ',') AS units, cast(n AS bigint) AS n_built, round((n - n_base) / n_base::double, 6) AS ratio FROM built QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY abs((n - n_base) / n_base::double - 0.5), len(units), units) = 1""")
def built_choice(spark, sf_dir):
    """Which of a conversation's next six turns, put behind the first without a blank, make it half as long again: what stands at a border
    becomes one word, so that sums of lengths are wrong and built texts are counted."""
    turns = I.top_per_group(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", ["turn"], _UNITS + 1)
    packed = turns.groupBy("conv_id").agg(F.min_by("text", "rank").alias("base"), F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", "text")))).alias("_u"))
    rows = packed.select("conv_id", "base", F.transform("_u", lambda x: x["text"]).alias("u")).withColumn("n_base", T.ws_count(F.col("base")).cast("bigint")).withColumn("sizes", F.transform("u", lambda x: T.ws_count(x)))
    rows = durable(G.choices(rows, "sizes", "n_base"))
    count = lambda df, text, name: df.withColumn(name, T.ws_count(F.col(text)).cast("bigint"))
    best = G.built_choice(rows, ["conv_id"], lambda units: F.concat("base", F.array_join(F.transform(units, lambda i: F.element_at("u", i + 1)), "")), count, "n_base")
    best = best.join(rows.select("conv_id", "n_base"), "conv_id")
    return rounded(best.select("conv_id", "n_base", F.array_join(F.transform("units", lambda u: u.cast("string")), ",").alias("units"), "n_built", "ratio"))


@CATALOGUE.add(f"WITH {TOKS} SELECT doc_id, cast(ord AS integer) AS ord, count(*) AS n_tokens, cast(sum(length(form)) AS bigint) AS n_chars, min(form) AS least_form, max(form) AS last_form FROM toks GROUP BY 1, 2")
def tokens_in_lines(spark, sf_dir):
    """Tokens of whole texts, told to lines by their places alone."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_chars = F.aggregate("forms", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
    return W.tokens_by_line(docs, "text", ("doc_id",)).select("doc_id", "ord", F.size("forms").cast("bigint").alias("n_tokens"), n_chars.alias("n_chars"), F.array_min("forms").alias("least_form"), F.array_max("forms").alias("last_form"))


@CATALOGUE.add(f"""WITH {TOKS}, w AS (SELECT item_id, string_split({_FLAT('text')}, ' ') AS w FROM benchmark), p AS (SELECT item_id, 0 AS alias, array_to_string(w[1:3], ' ') AS x FROM w UNION ALL SELECT item_id, 1, array_to_string(w[5:6], ' ') FROM w UNION ALL SELECT item_id, 2, w[2] FROM w),
l AS (SELECT doc_id, ord, ' ' || {_FLAT('line')} || ' ' AS t FROM lines)
SELECT item_id, doc_id, cast(ord AS integer) AS ord, cast(alias AS integer) AS alias FROM l JOIN p ON x <> '' AND contains(t, ' ' || x || ' ') QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY ord, alias) = 1""")
def dictionary_leakage(spark, sf_dir):
    """All names of a table in all texts: for each item and document the first line that has one of the item's phrases, and which."""
    w = F.split(T.flat(F.col("text")), " ")
    part = lambda a, n: F.array_join(F.slice(w, a, n), " ")
    names = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.array(part(1, 3), part(5, 2), part(2, 1))).alias("alias", "phrase"))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line")).select("doc_id", "ord", T.flat(F.col("line")).alias("text"))
    hits = J.phrases_in_texts(lines, names, ["doc_id", "ord"], ["item_id", "alias"])
    return J.first_hits(hits, ["item_id", "doc_id"], ["ord", "alias"])


@CATALOGUE.add(f"WITH {STUDY} SELECT variant, rho, {r6('mean lo hi')}, n FROM (SELECT variant, rho, {paired_sql('rho_real')} FROM conditions GROUP BY 1, 2)")
def running_means(spark, sf_dir):
    """Intervals of the realised rate from states that took in the conditions in three parts, one after the other."""
    rows, states = conditions(spark, sf_dir).select("prompt_id", "variant", "rho", "rho_real"), None
    for part in range(3):
        new = N.state(rows.where(F.pmod(F.xxhash64("prompt_id"), F.lit(3)) == part), ["variant", "rho"], "rho_real")
        states = durable(N.update(states, ["variant", "rho"], new))
    return rounded(states.select("variant", "rho", *[e.alias(n) for n, e in N.interval().items()]))


_VALUES = "vals AS (SELECT task_id, variant, rho, avg(ln_s_free) AS v FROM conditions WHERE n_red > 0 GROUP BY 1, 2, 3)"
_DIFFS = " UNION ALL ".join(f"SELECT a.rho, '{a} > {b}' AS contrast, a.v - b.v AS d FROM vals a JOIN vals b USING (task_id, rho) WHERE a.variant = '{a}' AND b.variant = '{b}' AND a.v - b.v IS NOT NULL" for a, b in PAIRS)


@CATALOGUE.add(f"WITH {STUDY}, {_VALUES}, diffs AS ({_DIFFS}) SELECT rho, contrast, {r6('mean lo hi')}, n FROM (SELECT rho, contrast, {paired_sql('d')} FROM diffs GROUP BY 1, 2)")
def running_contrasts(spark, sf_dir):
    """Paired contrasts from states that took in the values in three parts; tasks whose values came apart are paired anew."""
    values = durable(E.per_task(conditions(spark, sf_dir).where("n_red > 0"), F.col("ln_s_free")))
    before, states = values.limit(0), None
    for part in range(3):
        new = values.where(F.pmod(F.xxhash64("task_id", "variant"), F.lit(3)) == part)
        states = durable(N.update_pairs(states, before, new, "task_id", "variant", ["rho"], PAIRS))
        before = before.unionByName(new)
    return rounded(states.select("rho", "contrast", *[e.alias(n) for n, e in N.interval().items()]))


@CATALOGUE.add(f"WITH {STUDY}, {_TERCILES}, {_SAMPLE} SELECT 'relation' AS what, relation AS name, 3::bigint AS n FROM samp GROUP BY 2 UNION ALL SELECT 'tercile', cast(tercile AS varchar), 5::bigint FROM samp GROUP BY 2")
def balanced_totals(spark, sf_dir):
    """A constructed draw of three tasks from each relation and five from each tercile: its totals."""
    drawn = durable(M.balanced_draw(_sample(spark, sf_dir), "relation", "tercile", "task_id", 3, 5))
    by = lambda what, name: drawn.groupBy(F.col(name).cast("string").alias("name")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "name", "n")
    return by("relation", "relation").unionByName(by("tercile", "tercile"))


@CATALOGUE.add()
def block_alignment(spark, sf_dir):
    """Edited texts against their origins: half of the words, some of them replaced and two neighbours in five swapped, so that they are
    no subsequence and are aligned by matching blocks."""
    rows = keyed(spark, sf_dir).select("doc_id", "keys", C.kept_by_marks(F.col("keys"), F.col("marks"), (0.5,))[0]["kept"].alias("k"))
    swapped = lambda x, i: F.coalesce(F.try_element_at("k", F.when(i % 5 == 1, i + 2).when(i % 5 == 2, i).otherwise(i + 1).cast("int")), x)
    edited = F.transform(F.transform("k", swapped), lambda x, i: F.when(i % 7 == 3, F.concat(x, F.lit("*"))).otherwise(x))
    return A.align(rows.select("doc_id", "keys", edited.alias("small")), F.col("small"), F.col("keys"), ("doc_id",)).select("doc_id", "is_subsequence", "n_unassigned", "n_left")
