from linkloom.sources import tables
from linkloom.streaming.incremental import clean_to_parquet, raw_stream

HEAD = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"


def test_raw_tsv_round_trip(spark, tmp_path):
    (tmp_path / "train_source1.tsv").write_text(HEAD + 'S1-1\t"Acme" NA\t\tUS\nS1-2\tNULL\t12 St\tFrance\n')
    for k in (2, 3):
        (tmp_path / f"train_source{k}.tsv").write_text(HEAD + f"S{k}-5\tx\ty\tUS\n")
    rows = tables.load_records(spark, str(tmp_path), "train").orderBy("src", "num").collect()
    assert [(r.src, r.num, r.name, r.addr) for r in rows] == [(1, 1, '"Acme" NA', ""), (1, 2, "NULL", "12 St"), (2, 5, "x", "y"), (3, 5, "x", "y")]


def test_lists(spark, tmp_path):
    ents = spark.createDataFrame([("a",), ("b",)], "s1 string")
    pairs = spark.createDataFrame([("a", "S2-2"), ("a", "S2-1"), ("a", "S2-1")], "s1 string, rid string")
    lists = tables.list_table(ents, pairs)
    assert {r.s1: r.matched_entity_ids for r in lists.collect()} == {"a": "S2-1,S2-2", "b": ""}
    tables.write_list_file(lists, str(tmp_path / "out"))
    back = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out"))
    assert back.count() == 2
    assert tables.explode_lists(lists, "s1").count() == 2


def test_stage_resumes(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert tables.stage(spark, str(tmp_path / "s"), make).count() == 3
    assert len(made) == 1
    tables.write_json(spark, str(tmp_path / "m.json"), {"a": 1})
    assert (tmp_path / "m.json").read_text().strip().startswith("{")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text(HEAD + "S1-1\tAcme Ltd\t1 Main St\tUS\n")
    clean_to_parquet(raw_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).first().name_core == "acme"
