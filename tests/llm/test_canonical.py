import pytest

from terraloom.llm import canonical as c

LIST = [(1, "Hexaquar", "Egretta Sky 410 RTK", ""), (2, "Hexaquar", "Egretta Sky 410", ""), (3, "Törnvik", "Yaffleton 120 Pro", "Aspherion 50mm F1.8"), (4, "Törnvik", "Yaffleton 120 Pro", "Aspherion 24mm F2.8"), (5, "Ironwake", "Lapwingo 710", ""), (6, "Sarrowin", "Linnetra 110 II", "Clarivue 16mm F4.0"), (7, "Talvik Optics", "Curlewin 300", "")]
SCHEMA = "log_id bigint, make string, model string, lens_model string, ord string, entry int"


def run(spark, typed, ref=LIST):
    df = spark.createDataFrame([(i, *t, "x", 1) for i, t in enumerate(typed)], SCHEMA)
    r = spark.createDataFrame(ref, "ord int, make string, model string, lens_model string")
    got = {x.log_id: x.ord for x in c.map_values(df, "log_id", r, "ord", ["make", "model", "lens_model"]).collect()}
    return [got[i] for i in range(len(typed))]


CASES = [
    (("Hexaquar", "Ergetta Sky  410RTK", ""), 1), (("EGRETTA SKY 410 RTK", "Hexaq.", "-"), 1), (("Hexaquar Inc", "Egretta Sky 41O", None), 2), (("Hexaquar", "Egretta Sky 930", "fixed"), -1),
    (("Tornvik", "120 Pro Yaffleton", "24mm f/2.8"), 4), (("Törnvi.", "Yafletno l20 pro", "Asph. 50"), 3), (("Törnvik", "Yaffleton 120 Pro", None), -1), (("Törnvik", "Yaffleton 120", "Aspherion 50mm F1.8"), -1), (("Törnvik", None, "24mm"), -1),
    (("Törnvik", "Yaffleton 120 Pro w/ Aspherion 50mm F1.8", None), 3), ((None, "Ironwake Lapwingo no. 710 body", "built in"), 5), (("Ironwake", "Lapwingo 710 RTK", None), -1), (("Ironw", "Lapigo 710", None), 5), (("Sarrowin", "Limnetra_110II", "16 mm 4,0 Clarivue"), 6), (("sarrowin", "Linnetra ll0 ii", "Clarivue 24mm F2.8"), -1),
    (("Talvik", "Curlewin no. 300 (2nd unit)", ""), 7), (("Cheapcam", "Handycap 9000", None), -1), ((None, None, None), -1), (("", " ", "?"), -1), (("Hexaquar", "Old one from shed", None), -1), (("x" * 5000, "y" * 5000, "z" * 5000), -1),
]


def test_cases(spark):
    assert run(spark, [t for t, _ in CASES]) == [w for _, w in CASES]


def test_the_list_itself(spark):
    assert run(spark, [r[1:] for r in LIST]) == [r[0] for r in LIST]


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "Ironwake", "Lapwingo 710", "", "x", 1)] * 3 + [(None, "Ironwake", "Lapwingo 710", "", "x", 1)], SCHEMA)
    r = spark.createDataFrame(LIST, "ord int, make string, model string, lens_model string")
    fields = ["make", "model", "lens_model"]
    assert [(x.log_id, x.ord) for x in c.map_values(df, "log_id", r, "ord", fields).collect()] == [(1, 5)]
    assert [(x.log_id, x.ord) for x in c.map_values(df, "log_id", r.limit(0), "ord", fields).collect()] == [(1, -1)]
    assert c.map_values(df.limit(0), "log_id", r, "ord", fields).count() == 0


@pytest.mark.parametrize("text, number, suffixes", [("lapwingo710", "710", ""), ("sky4l0rtk", "410", "rtk"), ("redpolkis400II", "400", "ii"), ("400ii", "400", "ii"), ("9l0 Pro", "910", "pro"), ("2nd unit 120", "120", ""), ("Kittivane no. 41O Pro (2nd unit)", "410", "pro")])
def test_numbers(text, number, suffixes):
    v = c.read_value(None, text, None)
    assert (v.number, v.suffixes) == (number, suffixes)
