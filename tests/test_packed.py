import pytest

from gridloom.operators.packed import CODES, PERSONS, split_packed

PEOPLE = [
    ("r1", "Ann B. Smith; Bo Lee", ["Ann B. Smith", "Bo Lee"]),
    ("r2", "Smith, Ann; Lee, B.", ["Smith, Ann", "Lee, B."]),
    ("r3", "Ann B. Smith, Bo Lee and Cy Dow", ["Ann B. Smith", "Bo Lee", "Cy Dow"]),
    ("r4", '"Smith, A.", Bo C. Lee', ["Smith, A.", "Bo C. Lee"]),
    ("r5", "Ann B. Smith & Lee, Bo", ["Ann B. Smith", "Lee, Bo"]),
    ("r6", "Ann B. Smith;; Bo  Lee ;", ["Ann B. Smith", "Bo Lee"]),
    ("r7", "Ann B. Smith\nBo Lee", ["Ann B. Smith", "Bo Lee"]),
    ("r8", 'William "Will" Dow | Bo Lee', ['William "Will" Dow', "Bo Lee"]),
    ("r9", '"Katherine ""Kate"" Dow"; "Bo Lee"', ['Katherine "Kate" Dow', "Bo Lee"]),
    ("r10", "Ann B. Smith, Bo Lee, and Ann B. Smith", ["Ann B. Smith", "Bo Lee", "Ann B. Smith"]),
]
CODED = [
    ("r1", '["DS-A", "DS-B, PHASE 1 (2000)"]', ["DS-A", "DS-B, PHASE 1 (2000)"]),
    ("r2", "['DS-A', 'DS-B']", ["DS-A", "DS-B"]),
    ("r3", "{DS-A,DS-B}", ["DS-A", "DS-B"]),
    ("r4", 'DS-A|"DS-B, PHASE 1"|DS-C', ["DS-A", "DS-B, PHASE 1", "DS-C"]),
    ("r5", "DS-A DS-B DS-C", ["DS-A", "DS-B", "DS-C"]),
    ("r6", "DS-A,,DS-B;", ["DS-A", "DS-B"]),
    ("r7", "DS-A;DS-B|DS-C", ["DS-A", "DS-B", "DS-C"]),
]


def _split(spark, rows, grammar, field, filler, at_least=2):
    # The dialect model is learned from the column: the cases stand among ordinary texts.
    data = [(k, t) for k, t, *_ in rows] + [(f"f{i}", f) for i, f in enumerate(filler * 20)]
    df = spark.createDataFrame(data, f"record_id string, {field} string")
    out = {}
    for r in split_packed(df, ["record_id"], {field: grammar}, at_least).collect():
        out.setdefault(r.record_id, []).append((r.pos, r.value))
    return {k: [v for _, v in sorted(x)] for k, x in out.items() if k.startswith("r")}


def test_people(spark):
    filler = ["Ann B. Smith", "Bo Lee", "Cy D. Dow; Eva Poe", "Cy D. Dow, Eva Poe", "Smith, Ann"]
    assert _split(spark, PEOPLE, PERSONS, "collectors", filler) == {k: v for k, _, v in PEOPLE}


def test_codes(spark):
    filler = ["DS-X", "DS-X,DS-Y", "DS-X;DS-Y", '"DS-B, PHASE 1"', "DS-X DS-Y", "CN-Z"]
    assert _split(spark, CODED, CODES, "codes", filler) == {k: v for k, _, v in CODED}


def test_edges(spark):
    long = "; ".join(f"Ann B. Smith{i % 7}" for i in range(4_000))
    quoted = '"' + "x" * 200_000 + '"; Bo Lee'
    rows = [("a", None), ("b", ""), ("c", "   "), ("d", "[]"), ("e", "Bo Lee;"), ("f", long), ("g", "Ann B. Smith; Bo Lee"), ("g", "Ann B. Smith; Bo Lee"), (None, "Ann B. Smith; Bo Lee"), ("h", quoted)]
    df = spark.createDataFrame([(k, t, 1, "z", "z") for k, t in rows], "text string, collectors string, pos int, value string, shape string").withColumnRenamed("pos", "pos")
    out = split_packed(df, ["text"], {"collectors": PERSONS}, 2)
    assert out.columns == ["text", "field_name", "pos", "value"]
    got = {}
    for r in out.collect():
        got.setdefault(r.text, []).append(r.pos)
    assert set(got) == {"f", "g", None, "h"}
    assert sorted(got["f"]) == list(range(1, 4_001)) and sorted(got["g"]) == [1, 2] and sorted(got[None]) == [1, 2]
    one = split_packed(df, ["text"], {"collectors": PERSONS}, 1)
    assert one.where("text = 'e'").count() == 1 and one.where("text in ('a', 'b', 'c')").count() == 0
    assert split_packed(df.limit(0), ["text"], {"collectors": PERSONS}).count() == 0


@pytest.mark.parametrize("field", ["collectors", "bold_recordset_code_arr"])
def test_plain_texts_round_trip(spark, sf, field):
    """What is joined with ";" from the values found is split into the same values again."""
    from pyspark.sql import functions as F

    from gridloom.plans.problems import PACKED_FIELDS
    from gridloom.session import load

    rows = load(spark, sf, "bold_minimal_records").select("record_id", field)
    first = split_packed(rows, ["record_id"], {field: PACKED_FIELDS[field]}, 2)
    joined = first.groupBy("record_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: F.concat(F.lit('"'), F.replace(x["value"], F.lit('"'), F.lit('""')), F.lit('"'))), "; ").alias(field))
    again = split_packed(joined, ["record_id"], {field: PACKED_FIELDS[field]}, 2)
    assert first.exceptAll(again).count() == 0 and again.exceptAll(first).count() == 0
