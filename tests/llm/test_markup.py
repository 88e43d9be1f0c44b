import numpy as np
import pytest

from folium.llm import markup as L

YES = ["<b>x y</b>", "a<br/>b", "&laquo;x&raquo;", "# Head\n\ntext", "- one\n- two", "| a | b |\n|---|---|\n| 1 | 2 |", "```\ncode * 3\n```\nx", "a **bold** b", "[t](doc://x/1) y", "== Head ==\ntext", "[[a|b]] c", "{{form|code=1}} z", "\\section{X}\ny", "Form: $\\frac{1}{2}$", "\\begin{itemize}\n\\item A\n\\end{itemize}", "wort `x` wort", "<!-- r --> text"]
NO = ["", "plain text", "C:\\blank\\rev_1\\sheet_a.frx", "$47 – $51, Summe", "Summe* (4)", "СРОК_62_total", "3 < x, y > 4", "<23> 3", "____ / ____ /", "a & b", "1.1. Der Text.", "[data.Sum] (4)", "{3} Name", "~9 %", "a | 7", "N = 8 * 6 * 2", '[IIf([form.Rev] < 47, "low", "high")]']


@pytest.fixture(scope="module")
def boosted():
    return L.model()


def run(spark, boosted, texts):
    df = spark.createDataFrame([(str(k), k, t, "x") for k, t in enumerate(texts)], "doc_id string, node_id int, text string, clean string")
    return {r.node_id: r for r in L.strip_markup(df, boosted).collect()}


def test_cases(spark, boosted):
    texts = [*YES, *NO, None, "<b>" * 2000 + "x", "word " * 20_000 + "<i>a</i>"]
    got = run(spark, boosted, texts)
    assert set(got) == {*range(len(YES)), len(texts) - 2, len(texts) - 1}
    assert run(spark, boosted, []) == {}


SHAPES = ["<b>", "<!-- x -->", "&amp;", "# H", "== H ==", "a\n---", "a\n===", "- x", "+ x", "* x", "1. x", "> x", "a | b\n---|---\n1 | 2", "a | b\n:---|---:\n1 | 2", "a | b\n  :--|:-:\n1 | 2", "***", "___", "```\nx\n```", "~~~\nx\n~~~", "`x`", "**x**", "_x_", "~~x~~", "[t](u)", "![t](u)", "[t][u]", "[[x]]", "[https://u x]", "[doc://u x]", "{{x}}", "{|\nx\n|}", "''x''", "\\begin{a}x\\end{a}", "\\emph{x}", "\\par", "$x$", "$$x$$", "\\[x\\]", "\\(x\\)", "a\\\\ b", "\\%"]


@pytest.mark.parametrize("text", SHAPES)
def test_trigger_covers_every_pattern(text, monkeypatch):
    nodes = [(n.kind, n.a, n.b) for n in L.tree(text)]
    monkeypatch.setattr(L, "TRIGGER", L.re.compile(""))
    assert nodes == [(n.kind, n.a, n.b) for n in L.tree(text)] != []


def test_table_without_outer_pipes(spark, boosted):
    assert set(run(spark, boosted, ["Name | Qty\n:---|---:\nA | 5"])) == {0}


def test_structure(spark, boosted):
    r = run(spark, boosted, ["<h3>Titel</h3><ul><li>eins</li><li>zwei</li></ul><pre><code>if n &lt; 9</code></pre>", "# Kopf\n\n- a\n- b\n\n$\\frac{1}{2}$"])
    assert [x for x in r[0].clean.split("\n") if x] == ["Titel", "• eins", "• zwei", "if n < 9"]
    parts = {(s.role, r[1].clean[s.start : s.end]) for s in r[1].structure}
    assert {("heading", "Kopf"), ("list item", "a"), ("formula", "\\frac{1}{2}")} <= parts


def test_held_out_accuracy(boosted):
    right = total = 0
    for text, spans in L.sample(400, seed=1234):
        nodes = L.tree(text)
        if nodes:
            chosen = L.decode(nodes, boosted.odds(L.features(text, nodes)))
            for n in nodes:
                if n.parent is None:
                    total += 1
                    right += chosen[n.no] == any(a <= (n.ia if n.kind in ("list", "quote") else n.a) < b and y for a, b, y in spans)
    assert right / total > 0.97


def test_decoding_keeps_to_ancestors(boosted):
    rng = np.random.default_rng(0)
    for text, _ in L.sample(200, seed=5):
        nodes = L.tree(text)
        chosen = L.decode(nodes, rng.normal(size=len(nodes)))
        for n in nodes:
            p = n.parent
            if p is not None and chosen[n.no]:
                assert not (p.kind in L.OPAQUE and chosen[p.no])
            if p is not None and n.kind in L.STRUCTURAL.get(p.kind, ()) and not (p.parent and p.parent.kind in L.OPAQUE):
                assert chosen[n.no] == chosen[p.no]


HARD = ["_a " * 16000, "*a " * 16000, "~~a " * 16000, "''a " * 15000, "$$a " * 15000, "\\[a " * 15000, "<!--a " * 10000, "\\begin{a} " * 5000, "\\begin{a}[" * 5000, "\\a[" * 15000, "|a|b|c|d|\n|-|-|-|-|\n" + "|a|b|c|d|\n" * 5000, "- item\n" * 8000, "<b>" * 8000 + "x" + "</b>" * 8000, "# a" + " " * 50000 + "b", "|" * 30000 + "\n|-|\n" + "|" * 20000, "{|" * 30000, "[http://x" + " " * 50000, "~" * 60000, "a|b\n" + " " * 50000 + "x|"]


@pytest.mark.parametrize("k", range(len(HARD)))
def test_no_text_takes_long(boosted, k):
    """Work grows with the length only: what took minutes by trying every opening mark to the end takes a second or two at most."""
    import time

    began = time.process_time()
    nodes = L.tree(HARD[k])
    if nodes:
        L.cleaned(HARD[k], nodes, L.decode(nodes, boosted.odds(L.features(HARD[k], nodes))))
    assert time.process_time() - began < 4


def test_details(spark, boosted):
    texts = ["<h3>Titel</h3> <a href='doc://x/7'>ab</a>", "## Kopf\n\n```sql\nx = 1 * 2\n```\n\n[t](doc://x/1)\n\nwort", "== Eins ==\n[[Seite|Wort]] drei", "\\subsection{X}\nwort"]
    got = run(spark, boosted, texts)
    parts = {k: {(s.role, s.detail) for s in r.structure} for k, r in got.items()}
    assert {("heading", "3"), ("link", "doc://x/7")} <= parts[0] and {("heading", "2"), ("code", "sql"), ("link", "doc://x/1")} <= parts[1]
    assert {("heading", "2"), ("link", "Seite")} <= parts[2] and ("heading", "2") in parts[3]
