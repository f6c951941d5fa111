import pytest
from pyspark.sql import functions as F

from brevispark.sources import files, records, sinks
from brevispark.sources.named_texts import read_named_texts, write_named_texts
from brevispark.streaming.incremental import process_new


def test_delimited_and_id_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('id\tname\n1\t"x ""y"""\n2\t\n')
    assert [tuple(r) for r in files.read_tsv(spark, str(tmp_path / "a.tsv")).collect()] == [("1", 'x "y"'), ("2", None)]
    (tmp_path / "b.csv").write_text('id,paraphrase\n1,"two\nlines"\n')
    df = files.read_csv(spark, str(tmp_path / "b.csv"), ("id", "paraphrase"), multi_line=True)
    assert df.first().paraphrase == "two\nlines"
    with pytest.raises(ValueError, match="template_id"):
        files.read_csv(spark, str(tmp_path / "b.csv"), ("template_id",))
    (tmp_path / "ids.txt").write_text("1\n\n 7 \n")
    ids = files.read_ids(spark, str(tmp_path / "ids.txt"))
    assert [r.id for r in ids.collect()] == ["1", "7"] and files.needed_only(df, ids, "id").count() == 1
    (tmp_path / "m.json").write_text('{"seed": 7,\n "allocation": {"a": 1}}')
    assert files.read_manifest(spark, str(tmp_path / "m.json")).first().allocation.a == 1


def test_text_trees(spark, tmp_path):
    for variant, name, text in (("basis", "12_0.5", "one\ntwo"), ("semantic", "7_0.25", "ä")):
        (tmp_path / variant).mkdir()
        (tmp_path / variant / f"{name}.txt").write_text(text)
    got = sorted(tuple(r) for r in files.read_text_tree(spark, str(tmp_path)).collect())
    assert got == [("basis", "12", 0.5, 0.5, "one\ntwo"), ("semantic", "7", 0.25, 0.75, "ä")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 0.5), (2, "b", 0.25)], "k int, v string, rate double")
    sinks.write_csv(df, str(tmp_path / "csv"), ("k",), single=True)
    assert next((tmp_path / "csv").glob("part*")).read_text() == "k,v,rate\n1,,0.5\n2,b,0.25\n"
    sinks.write_tsv(df, str(tmp_path / "tsv"))
    assert files.read_tsv(spark, str(tmp_path / "tsv")).count() == 2
    sinks.write_ids(df, "k", str(tmp_path / "ids"))
    assert files.read_ids(spark, str(tmp_path / "ids")).count() == 2
    assert [r.l for r in df.select(sinks.rate_label("rate").alias("l")).orderBy("k").collect()] == ["0.5", "0.25"]
    sinks.write_text_tree(df.withColumn("variant", F.lit("x")).withColumn("name", F.col("k").cast("string")).withColumn("text", F.lit("a\nb")), str(tmp_path / "tree"))
    assert next((tmp_path / "tree" / "variant=x" / "name=1").glob("part*")).read_text() == "a\nb\n"
    sinks.replace_table(df, str(tmp_path / "t"))
    sinks.append_table(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    assert sinks.run_record(spark, "test", __file__, {"a": 1}).first().configuration == '{"a": 1}'


def test_new_files_are_taken_once(spark, tmp_path):
    step = lambda df: df.withColumn("w", F.col("v") * 2)
    args = (spark, str(tmp_path / "in"), "v bigint", step, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    spark.range(3).withColumnRenamed("id", "v").write.mode("append").parquet(str(tmp_path / "in"))
    process_new(*args)
    spark.range(10, 12).withColumnRenamed("id", "v").write.mode("append").parquet(str(tmp_path / "in"))
    process_new(*args)
    process_new(*args)
    assert sorted(r.w for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 2, 4, 20, 22]


ODD = [(1, 'plain', "x"), (2, 'two\nlines, and a comma', None), (3, 'a "quoted" word\n\n"', "y"), (4, "", "z"), (5, "ends with break\n", "w"), (6, "\n", "v"), (7, "é\n" * 40, "u")]


@pytest.mark.parametrize("size", ["40b", "64b", "1000b", "10m"])
def test_records_with_line_breaks_are_read_by_many_tasks(spark, tmp_path, size):
    import csv
    import random

    rnd = random.Random(size)
    rows = [(i, *rnd.choice(ODD)[1:]) for i in range(300)]
    for name, part in (("a", rows[:250]), ("b", rows[250:]), ("c", [])):
        with open(tmp_path / f"{name}.csv", "w", newline="") as f:
            out = csv.writer(f, lineterminator="\n" if name == "a" else "\r\n")
            out.writerow(["id", "text", "more"])
            out.writerows(part)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = records.read_records(spark, str(tmp_path), "id int, text string, more string")
        if size != "10m":
            assert records.records(spark, str(tmp_path)).select("block").distinct().count() > 5
        plain = files.read_csv(spark, str(tmp_path / "a.csv"), multi_line=True).selectExpr("cast(id as int) id", "text", "more")
        mine = sorted((r.id, r.text, r.more) for r in got.collect())
        assert [r[:1] + tuple(x or "" for x in r[1:]) for r in mine] == [(i, t, m or "") for i, t, m in rows]
        assert [r for r in mine if r[0] < 250] == sorted((r.id, r.text, r.more) for r in plain.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_named_texts(spark, tmp_path):
    root = str(tmp_path / "tree")
    rows = [("basis", f"{i}_0.5", f"text {i}\nof two lines") for i in range(40)] + [("a/b", "7_0.25", ""), ("a/b", "ä_1", "é\n")]
    df = spark.createDataFrame(rows, "variant string, name string, text string").repartition(5)
    write_named_texts(df, root)
    found = {str(p.relative_to(root)): p.read_bytes().decode() for p in (tmp_path / "tree").rglob("*") if p.is_file()}
    assert found == {f"{v.replace('/', '%2F')}/{n}.txt": t for v, n, t in rows}  # and nothing else
    back = files.read_text_tree(spark, root)
    assert sorted((r.variant, r.id, r.rate, r.text) for r in back.collect()) == sorted((v, n.split("_")[0], float(n.split("_")[1]), t) for v, n, t in rows if t)  # Spark's readers skip empty files
    write_named_texts(spark.createDataFrame([("basis", "1_0.5", "new")], "variant string, name string, text string"), root)
    assert (tmp_path / "tree" / "basis" / "1_0.5.txt").read_text() == "new" and len(list((tmp_path / "tree" / "basis").iterdir())) == 40
    write_named_texts(spark.createDataFrame([("c", "1_1", "last")], "variant string, name string, text string"), root, overwrite=True)
    assert [str(p.relative_to(root)) for p in (tmp_path / "tree").rglob("*") if p.is_file()] == ["c/1_1.txt"]


def test_named_texts_leave_nothing_when_they_fail(spark, tmp_path):
    root = tmp_path / "tree"
    with pytest.raises(Exception, match="a variant, a name and a text"):
        write_named_texts(spark.createDataFrame([("a", f"{i}", None if i == 30 else "x") for i in range(40)], "variant string, name string, text string").repartition(4), str(root))
    assert not [p for p in root.rglob("*") if p.is_file()]
    with pytest.raises(Exception, match="one name|are named"):
        write_named_texts(spark.createDataFrame([("a", "same", "x"), ("a", "same", "y")], "variant string, name string, text string").repartition(2), str(root))
    assert not [p for p in root.rglob("*") if p.is_file()]


def test_named_texts_are_read_back_many_files_a_task(spark, tmp_path):
    root, kind = str(tmp_path / "tree"), "variant string, name string, text string"
    rows = [("basis", f"{i}_0.5", f"text {i}\n") for i in range(400)] + [("a/b", "7_0.25", ""), ("_c", ".d%2F_1", "é"), ("%5F", "%25", "x"), (".", "e/f", "\r\n\0")]
    write_named_texts(spark.createDataFrame(rows, kind).repartition(3), root)
    (tmp_path / "tree" / "_temporary" / "run").mkdir(parents=True)
    (tmp_path / "tree" / "_temporary" / "run" / "1_1.txt").write_text("of a run that is on its way")
    back = read_named_texts(spark, root)
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)  # empty texts too
    assert back.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    write_named_texts(spark.createDataFrame([], kind), str(tmp_path / "none"))
    assert not read_named_texts(spark, str(tmp_path / "none")).count()


def test_named_texts_query_keeps_empty_texts(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    spark.createDataFrame([(i, "en", "web", "" if i % 4 else f"text {i}") for i in range(12)], "doc_id bigint, lang string, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, "user", "" if i % 3 else "turn") for i in range(9)], "conv_id bigint, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["named_texts"]).fetchall()
    assert sorted(tuple(r) for r in entry.queries()["named_texts"](spark, str(tmp_path)).collect()) == sorted(want)
