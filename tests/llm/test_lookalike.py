from weftline.llm import queries
from weftline.llm.lookalike import repair_texts, same_looks

SCHEMA = "id long, source_paper_id long, sample_id string, performance_unit string, evidence_text string, raw string"


def repaired(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return {r.raw: r.repaired for r in repair_texts(df).collect()}


def test_repair(spark):
    texts = ["basalt", "bаsаlt", "ｂａｓａｌｔ", "ba​salt ", "Köper", "Köper", "Кöpеr", "N", "5 N", "Ν", "Москва", "α-1", "a-1", "2 a", "m²", "m2", "ß", "B", "speciﬁc", "specific", "а-1", None, ""]
    got = repaired(spark, texts)
    assert None not in got and got[""] == ""
    assert {got[t] for t in texts[:4]} == {"basalt"}
    assert got["Köper"] == got["Köper"] == got["Кöpеr"] == "Köper"
    assert got["Ν"] == "N" and got["Москва"] == "Москва" and got["speciﬁc"] == "specific"
    assert got["а-1"] == got["a-1"] == "a-1" and got["α-1"] == "α-1"
    assert got["m²"] != got["m2"] and got["ß"] != got["B"]


def test_dominant_script_first_and_vocabulary(spark):
    # a Russian text keeps its words, however often their look-alikes occur
    texts = ["сор в воде", *[f"cop {i}" for i in range(5)], "сор", "cор", "σ of K", "σ of Κ", "мороз", "мopоз", "morose мopoз"]
    got = repaired(spark, texts)
    assert got["сор в воде"] == "сор в воде" and got["сор"] == "сор"
    assert got["cор"] == "сор"  # two of three letters are Cyrillic, and the word is known
    assert got["σ of Κ"] == "σ of K"
    assert got["мopоз"] == "мороз" and got["morose мopoз"] == "morose мороз"
    # without the Cyrillic word the other script's form is taken, without either none
    assert repaired(spark, ["cор", "cop 1"])["cор"] == "cop" and repaired(spark, ["cор"])["cор"] == "cор"


def test_hot_look_and_classes(spark):
    rows = [(i, 1, "S1" if i < 300 else "S1 ", None, None, "x") for i in range(302)]
    got = same_looks(spark.createDataFrame(rows, SCHEMA))
    assert got.count() == 600 and got.where("id_a >= id_b").count() == 0


def test_no_vocabulary_no_change(spark):
    assert repaired(spark, ["хуz"])["хуz"] == "хуz"


def test_pairs(spark):
    rows = [
        (1, 1, "Sample 1", "MPa", "it was 5 MPa", "x"), (1, 1, "Sample 1", "MPa", "it was 5 MPa", "x"), (2, 1, "Ѕаmple 1", "ΜРа", "it was 5 MPa", "x"), (3, 2, "Sample 1", "MPa", None, "x"),
        (4, 1, None, "MРa", "it was 5　MPa", "x"), (5, 1, "Other", "ＭＰａ", None, "x"), (6, None, "Sample 1", "MPa", None, "x"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in same_looks(df).collect()}
    assert got == {("sample_id", 1, 2), ("performance_unit", 1, 2), ("evidence_text", 1, 4), ("evidence_text", 2, 4)}
    assert same_looks(df.limit(0)).count() == 0


def test_very_long_text(spark):
    long = "word " * 40_000
    assert repaired(spark, [long + "basalt", long + "bаsalt", "basalt"])[long + "bаsalt"] == long + "basalt"


def test_repaired_over_all_fields(spark, tmp_path):
    rows = [(1, 1, "bаsalt", "МPa", "it was 5 MPa", "x"), (2, 1, "basalt", None, "of bаsаlt", "x"), (3, None, "MPa", "", None, "x"), (3, None, "MPa", "", None, "x")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "candidate_items.parquet"))
    got = [tuple(r) for r in queries.QUERIES["p6_repaired"](spark, str(tmp_path)).select("field_name", "raw", "repaired").collect()]
    want = {
        ("sample_id", "bаsalt", "basalt"), ("sample_id", "basalt", "basalt"), ("sample_id", "MPa", "MPa"), ("performance_unit", "МPa", "MPa"), ("performance_unit", "", ""),
        ("evidence_text", "it was 5 MPa", "it was 5 MPa"), ("evidence_text", "of bаsаlt", "of basalt"),
    }
    assert set(got) == want and len(got) == len(want)
