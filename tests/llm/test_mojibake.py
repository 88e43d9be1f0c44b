import random

import pytest

from folium.llm import mojibake as L

WORDS = "накладная договор склад отметка приёмка подпись масса количество дата номер строка бланк проверка сверка остаток печать лист карта".split()


def text(rng):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randrange(4, 9))).capitalize() + "."


def frame(spark, rows):
    return spark.createDataFrame([(f"D{k}", k, tag, {"Text": t} if t is not None else {}, "F1" if k % 3 else None, "clash") for k, (tag, t) in enumerate(rows)], "doc_id string, node_id int, tag string, attrs map<string,string>, form_code string, text string")


def test_repair(spark):
    rng = random.Random(5)
    rows = [("TextObject", text(rng)) for _ in range(300)]
    chains = [("utf-8", "cp1252"), ("cp1251", "latin-1"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("utf-8", "cp866")]
    want = {}
    for w, r in chains * 3:
        good = text(rng)
        want[len(rows)] = good
        page = L._SIGNS[r]
        rows.append(("TextObject", "".join(page[b] for b in good.encode(w))))
    lost = len(rows)
    rows += [("TextObject", "Накл\ufffdдная"), ("TextObject", None), ("TextObject", ""), ("TextObject", "plain"), ("TableCell", "РќРѕРјРµСЂ"), ("RichObject", "{\\rtf1\\ansi\\ansicpg1252 " + "".join(f"\\'{b:02x}" for b in text(rng).encode("cp1251")) + "}"), ("RichObject", "{\\rtf1\\ansi\\ansicpg1251 " + "".join(f"\\'{b:02x}" for b in text(rng).encode("cp1251")) + "}")]
    got = {r.node_id: r for r in L.repair(frame(spark, rows + rows[-7:])).collect()}
    assert {k for k in got if k <= lost + 6} == {*want, lost, lost + 5}
    assert sum(got[k].repaired == t for k, t in want.items()) >= len(want) - 1
    assert got[lost].recovered is False


@pytest.mark.parametrize("chain", [("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "koi8-r"), ("cp1251", "latin-1")])
def test_a_third_garbled_by_one_chain(spark, chain):
    rng = random.Random(7)
    good = [text(rng) for _ in range(300)]
    page = L._SIGNS[chain[1]]
    rows = [("TextObject", "".join(page[b] for b in t.encode(chain[0])) if k % 3 == 0 else t) for k, t in enumerate(good)]
    got = {r.node_id: r.repaired for r in L.repair(frame(spark, rows)).collect()}
    assert got == {k: t for k, t in enumerate(good) if k % 3 == 0}


def test_short_texts_in_a_large_source(spark):
    rng = random.Random(3)
    page = L._SIGNS["cp1251"]
    short = {w: "".join(page[b] for b in w.encode("koi8-r")) for w in ("дата", "лист", "номер", "тара", "кол")}
    rows = [(f"D{k}", k, "TextObject", {"Text": text(rng)}, "F") for k in range(8000)] + [(f"D{k}", k, "TextObject", {"Text": t}, "F") for k, t in enumerate([*short.values()] * 8, 8000)]
    nodes = spark.createDataFrame(rows, "doc_id string, node_id int, tag string, attrs map<string,string>, form_code string")
    suspects, _ = L.estimate(L.declared(nodes))
    assert {r.text for r in suspects.collect()} >= set(short.values())
    got = L.repair(nodes).collect()
    assert sorted(r.node_id for r in got) == [*range(8000, 8040)] and {(r.repaired, r.text) for r in got} == set(short.items())


def test_capitals_stay(spark):
    rng = random.Random(4)
    rows = [("TextObject", text(rng)) for _ in range(300)] + [("TextObject", w) for w in ("НОМЕР", "СКЛАД № 5", "ДАТА") * 10]
    assert L.repair(frame(spark, rows)).count() == 0


def test_explained_garble_leaves_no_bigrams(spark):
    rng = random.Random(6)
    rows = [("TextObject", text(rng)) for _ in range(300)]
    for w, r in (("utf-8", "cp1252"), ("utf-8", "cp1251"), ("koi8-r", "cp1251")):
        page = L._SIGNS[r]
        rows += [("TextObject", "".join(page[b] for b in text(rng).encode(w))) for _ in range(20)]
    own, params = L.estimate(L.declared(frame(spark, rows)))
    proper = {ab for _, t in rows[:300] for w in L.odd_words(t) for ab in L.pairs_of(w)}
    left = {ab: n for ab, n in params.pairs.items() if ab not in proper and n > 0.5}
    assert sum(left.values()) < 0.02 * sum(params.pairs.values())
    assert abs(sum(params.pairs.values()) - sum(len(w) + 1 for _, t in rows[:300] for w in L.odd_words(t))) < 0.2 * sum(params.pairs.values())
    assert own.where("size is null or own is null").count() == 0


def test_quick_passes_all_that_tell(spark):
    rng = random.Random(8)
    good = [text(rng) for _ in range(200)] + ["Größe Länge Straße für Übergabe " * 3, "naïve café"]
    bad = ["".join(L._SIGNS[r][b] for b in t.encode(w, "ignore")) for t in good[:60] for w, r in (*L.SINGLE, ("utf-8", "cp1252"), ("utf-8", "koi8-r"))]
    words = {w for t in good + bad for w in L.odd_words(t)} | {"☃𝔘ж", "ы" * 300, "Ђ"}
    judge = L.Judge(L.Params({ab: 3.0 for t in good for w in L.odd_words(t) for ab in L.pairs_of(w)}, {}, 500.0, 1e-4))
    for room in (1500, 20):
        some = sorted(words)
        table = L.Table(judge.speech, room)
        assert all(m for w, m in zip(some, table.may_tell(some)) if judge.word(w)[1])
        assert table.scores(some) == pytest.approx([judge.speech.score(w) for w in some])
    other = L.Judge(judge.p)
    other.learn(some)
    assert all(other.words[w][1] == judge.word(w)[1] for w in some)


def test_empty(spark):
    assert L.repair(frame(spark, [])).count() == 0 and L.repair(frame(spark, [("TextObject", "ascii")])).count() == 0


def test_undo():
    assert L.undo_utf8("FÃ¤llig", "cp1252") == "Fällig" and L.undo_utf8("Fällig", "cp1252") is None
    assert "Größe" in L.undone_utf8("GrÃƒÂ¶ÃƒÅ¸e").values()
    assert L.undone_single("юбрнп")["cp1251>koi8-r"] == "АВТОР"
