from folium.llm import leakage as L

ITEM = "Der erste Punkt zählt, der zweite nicht; wie viele Linien passen auf den Bogen mit 3 Rändern und 7 Ecken?"


def frame(spark, docs):
    return spark.createDataFrame([(k, t, "x") for k, t in enumerate(docs)], "doc_id int, text string, item_id string")


def brute(text, item, n=13):
    a, b = L.words_of(text), L.words_of(item)
    grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
    return any(tuple(a[i : i + n]) in grams for i in range(len(a) - n + 1))


def test_found(spark):
    words = ITEM.split()
    docs = [None, "", "vor. " + ITEM.upper() + " nach", " ".join(words[2:15]) + " x", " ".join(words[2:14]), "**" + "\n".join(words[:13]) + "**", ITEM + " " + ITEM, "y " * 30_000 + ITEM, "ş Ⅳ ² " + " - ".join(words[5:19])]
    items = spark.createDataFrame([(1, ITEM, 0), (1, ITEM, 0), (2, None, 0), (3, "too short", 0), (4, ITEM, 0)], "item_id int, item_text string, text int")
    got = {tuple(r) for r in L.leaked(frame(spark, docs), items).collect()}
    assert got == {(k, i) for k, t in enumerate(docs) for i in (1, 4) if t and brute(t, ITEM)}
    assert {k for k, _ in got} == {2, 3, 5, 6, 7, 8}


def test_marks_and_joiners_are_no_words(spark):
    words = ITEM.split()
    assert L.words_of("a \u200d b \ufe0f c \u0301 d ³ ½") == ["a", "b", "c", "d", "³", "½"]
    docs = [f" {sign} ".join(words[:13]) for sign in ("\u200d", "☎\ufe0f", "\u0301", "—")] + [" ³ ".join(words[:13])]
    items = spark.createDataFrame([(1, ITEM)], "item_id int, item_text string")
    assert {r.doc_id for r in L.leaked(frame(spark, docs), items).collect()} == {0, 1, 2, 3}


def test_offsets_and_empty(spark):
    text = "vor «" + ITEM + "» nach"
    items = spark.createDataFrame([(1, ITEM)], "item_id int, item_text string")
    hit = L.find_passages(frame(spark, [text]), items).collect()[0]
    assert text[hit.char_start : hit.char_end] == ITEM[:-1] and hit.n_words == 20 and hit.item_word == 0
    assert L.leaked(frame(spark, []), items).count() == 0 and L.leaked(frame(spark, [text]), items.limit(0)).count() == 0
    assert L.find_passages(frame(spark, [text]), items, block_chars=1).count() == 1
