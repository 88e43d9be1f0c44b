import pytest

from folium.llm import lookalike as L

SAME = ["", "Drawing: № 5, m², ½ “x” – y — …", "ГОСТ Р ИСО, СРО РС, РСУ", "BOM, CAM, HTTP, COM 3", "Δt = 5, μ = 0,1", "за\u0301мок", "Œuvre déjà reçue", "Σύνολο σελίδας", "a  b\t\r\nc", "ЦЕХ «ÅKE» 4", "USB-порт, XL", "x", "о c а"]
TURNED = {"Ｄｒａｗｉｎｇ：\u3000５": "Drawing: 5", "u\u0308ber \u0438\u0306": "über й", "a\u00a0b\u2011c\u00ad\u200bd\ufeff": "a b-cd", "Мapшрут": "Маршрут", "Μаршрут": "Маршрут", "Nеt wеight": "Net weight", "HOMEP": "НОМЕР", "СУMMА": "СУММА", "учёт oт": "учёт от", "yчётa": "учёта"}


def run(spark, texts, **more):
    df = spark.createDataFrame([(k, k, t, "x") for k, t in enumerate(texts)], "doc_id int, node_id int, text string, attrs string")
    captions = spark.createDataFrame([("НОМЕР",), ("СУММА",), ("Масса брутто",), ("Net weight",), (None,)], "caption_text string")
    return {r.doc_id: r.clean for r in L.consistent(df, captions, **more).collect()}


def test_forms(spark):
    texts = [*SAME, *TURNED, None, "a\u00a0" * 50_000]
    got = run(spark, texts)
    assert {texts[k]: v for k, v in got.items() if k < len(texts) - 1} == TURNED and got[len(texts) - 1] == "a " * 50_000
    clean = run(spark, list(TURNED.values()))
    assert clean == {}  # a consistent form stays as it is
    assert len(run(spark, texts, changed_only=False)) == len(texts) and run(spark, []) == {}


@pytest.mark.parametrize("name", ["Latin", "Cyrillic", "Greek"])
def test_twins(name):
    a, b = L.twins(name)
    assert len(a) == len(b) == len(set(a))


def test_long_batches_are_sliced(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 900_000] * 5 + [None, ""] + ["y" * 3_000_000])], names=["text"])
    assert [b.num_rows for b in L.sliced(batch, 0)] == [2, 2, 3, 1] and L.sliced(batch.slice(0, 0), 0).__next__ is not None
    df = spark.createDataFrame([(k, "Ｎｏ\u00a0\u200b" + "текст " * 3300) for k in range(600)], "k int, text string")
    captions = spark.createDataFrame([("No",)], "caption_text string")
    assert L.consistent(df, captions).where("clean like 'No текст%'").count() == 600
