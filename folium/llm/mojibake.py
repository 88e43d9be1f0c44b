"""Problem 1: text garbled by a wrong character encoding.

A record's text is its original passed through a latent chain of wrong decodings,
in all or part of its words. Expectation-maximisation learns, over all records,
how likely each chain is for each source and field and what proper text looks
like (a character model); weak evidence of single words is pooled over a record
and its source. Each record is then repaired by the posterior of its chain.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from operator import add
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.functions.rtf import is_rtf, rtf_text
from folium.runtime import collect_bounded, cut

# The code pages between which texts get lost.
PAGES = ("cp1251", "cp1252", "latin-1", "cp866", "koi8-r", "cp437")
#: Wrong readings of UTF-8 bytes, and (written, read) pairs of single-byte pages.
UTF8_READ = ("cp1251", "cp1252", "latin-1", "cp866", "koi8-r", "cp437")
SINGLE = tuple((w, r) for w in ("cp1251", "cp866", "koi8-r", "cp1252") for r in PAGES if w != r and (w, r) not in (("cp1252", "latin-1"), ("cp866", "cp437")))
LOST = "�"
CLEAN = ""
STAY, SWITCH = math.log(0.95), math.log(0.05)  # from one word of a damaged record to the next
CAPITALS = math.log(0.05)  # words all in capitals: too few in most texts for bigrams of their own
START, END = "\x02", "\x03"
ROOM = 200_000


def _page(name: str) -> list[str]:
    """The 256 signs of a page; bytes without a sign stay as control codes."""
    return [bytes([b]).decode(name, "ignore") or chr(b) for b in range(256)]


_SIGNS = {p: _page(p) for p in PAGES}
_BYTES = {p: {ord(c): b for b, c in enumerate(s) if b > 127} for p, s in _SIGNS.items()}
# Characters outside a page become one that no UTF-8 sequence has.
_SHIFT = {w + ">" + r: {c: _SIGNS[w][b] for c, b in _BYTES[r].items()} for w, r in SINGLE}


_BLANKS = {z: {c for c, was in shift.items() if was.isspace()} for z, shift in _SHIFT.items()}


def _runs(page: str, telling: bool = False) -> str:
    """A pattern of UTF-8 sequences in the signs of a page; telling: whose further bytes are no blanks or Cyrillic letters.

    In cp866 all but the first bytes are ordinary Cyrillic letters: there only two-byte
    sequences and those of punctuation and signs count.
    """
    signs = _SIGNS[page]
    part = lambda a, b: "[" + re.escape("".join(signs[a:b])) + "]"
    rest = part(0x80, 0xC0)
    if telling:
        rest = "[" + re.escape("".join(c for c in signs[0x80:0xC0] if not c.isspace() and not "\u0400" <= c <= "\u04ff")) + "]"
    if page == "cp866":
        return f"{part(0xC2, 0xE0)}{part(0x80, 0xC0)}|{part(0xE2, 0xE3)}{part(0x80, 0x8C)}{part(0x80, 0xC0)}"
    return f"{part(0xC2, 0xE0)}{rest}|{part(0xE0, 0xF0)}{rest}{{2}}|{part(0xF0, 0xF5)}{rest}{{3}}"


RUNS = {p: re.compile(f"(?:{_runs(p)})+") for p in UTF8_READ}
TELLING = re.compile("|".join(_runs(p, True) for p in UTF8_READ))
ANY_RUN = re.compile("|".join(_runs(p) for p in UTF8_READ))


def undo_utf8(word: str, page: str) -> str | None:
    """The word with every UTF-8 sequence that was read in ``page`` read rightly; None if there is none."""
    out, at, some = [], 0, False
    signs = _BYTES[page]
    for m in RUNS[page].finditer(word):
        try:
            good = bytes([signs[ord(c)] for c in m[0]]).decode("utf-8")
        except UnicodeDecodeError:
            continue
        some = some or not all(c.isspace() for c in m[0][1::2])
        out += [word[at : m.start()], good]
        at = m.end()
    return "".join(out) + word[at:] if some else None  # a letter and a hard blank alone are no sign of UTF-8


@lru_cache(ROOM)
def undone_utf8(word: str, depth: int = 3) -> dict[str, str]:
    """What the word may have been before UTF-8 was read wrongly, once or several times, by chain (the last reading first)."""
    out: dict[str, str] = {}
    for page in UTF8_READ if ANY_RUN.search(word) else ():
        was = undo_utf8(word, page)
        if was is not None and was != word:
            out[f"utf-8>{page}"] = was
            if depth > 1 and not was.isascii():
                for rest, older in undone_utf8(was, depth - 1).items():
                    out[f"utf-8>{page} {rest}"] = older
    return out


MIXED = re.compile(r"[A-Za-z][^\W\x00-\x7f]|[^\W\x00-\x7f][A-Za-z]")
_LATIN = [(z, s, frozenset(s)) for z, s in _SHIFT.items() if z.startswith("cp1252")]
_CYRILLIC = [(z, s, frozenset(s)) for z, s in _SHIFT.items() if not z.startswith("cp1252")]


@lru_cache(ROOM)
def undone_single(word: str) -> dict[str, str]:
    """What the word may have been before its bytes were read in another single-byte page, by chain."""
    out: dict[str, str] = {}
    far = {ord(c) for c in word if c > "\x7f"}
    letters = {c for c in far if chr(c).isalpha()}
    # Accented letters stand among plain ones, Cyrillic letters among their like.
    for name, shift, page in _LATIN if MIXED.search(word) else _CYRILLIC:
        # A word read in a page has letters of that page only; more than its blanks were read wrongly, and no letter was a blank.
        if letters <= page and letters.isdisjoint(_BLANKS[name]):
            was = word.translate(shift)
            if was != word and (letters or any(shift.get(c, chr(c)) != chr(c) and not chr(c).isspace() for c in far)):
                out[name] = was
    return out


@lru_cache(ROOM)
def undone(word: str) -> dict[str, str]:
    """What the word may have been, by chain. Every word: how common a wrong reading is must not make it pass as proper."""
    past = undone_utf8(word)
    out = dict(past)
    for z, was in [("", word), *past.items()]:
        # a sign or two that came out of UTF-8 are believed
        if not z or sum(c > "\x7f" for c in was) > 2:
            out |= {f"{z} {y}".strip(): older for y, older in undone_single(was).items()}
    return out


WORDS = re.compile(r"[^ \t\r\n]+")


class Speech:
    """A character model: bigrams backed off to single characters and to an even share, times the root of the single
    characters' own shares, lest a rare but orderly alphabet look more proper than the common one it stands for."""

    def __init__(self, pairs: dict[str, float], back: float = 10.0, other: float = 1e-7):
        self.pairs = pairs
        self.first: Counter = Counter()
        single: Counter = Counter()
        for ab, n in pairs.items():
            self.first[ab[0]] += n
            single[ab[1]] += n
        total = sum(single.values()) + 1.0
        self.single = {c: max(n, 0.0) / total + other for c, n in single.items()}
        self.back, self.other, self.cost = back, other, _Costs(self)

    def pair(self, ab: str) -> float:
        share = self.single.get(ab[1], self.other)
        return math.log((max(self.pairs.get(ab, 0.0), 0.0) + self.back * share) / (max(self.first.get(ab[0], 0.0), 0.0) + self.back)) + 0.5 * math.log(share)

    def score(self, word: str) -> float:
        return sum(map(self.cost.__getitem__, map(add, START + word, word + END)))


class _Costs(dict):
    def __init__(self, speech: Speech):
        self.speech = speech

    def __missing__(self, ab: str) -> float:
        self[ab] = cost = self.speech.pair(ab)
        return cost


@lru_cache(ROOM)
def looks_utf8(word: str) -> bool:
    """Whether the word holds UTF-8 sequences as some page shows them; few proper words do."""
    return TELLING.search(word) is not None


def pairs_of(word: str) -> list[str]:
    s = START + word + END
    return [s[i : i + 2] for i in range(len(s) - 1)]


class Params(NamedTuple):
    pairs: dict  # expected bigram counts of proper text
    overall: dict  # chain -> expected records
    total: float  # records
    odd: float  # share of proper words that look like UTF-8 read wrongly


def either(a: float, b: float) -> float:
    """The log of the sum of two shares given by their logs."""
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


class Judge:
    """Posterior of the chains of a record."""

    def __init__(self, params: Params):
        self.speech, self.p = Speech(params.pairs), params
        self.words: dict[str, tuple] = {}
        self.table: Table | None = None
        self.rare = math.log(params.odd)
        self.floor, self.total = 1e-5 * params.total + 0.5, params.total + 1.0  # expected records of a chain that has none

    def word(self, word: str) -> tuple[dict[str, tuple[float, str]], frozenset]:
        """The chains that would change the word, with the gain in log likelihood, and those that gain by more than lone signs."""
        return self.words.get(word) or self.judged(word, self.proper)

    def learn(self, words: Iterable[str]) -> None:
        """Judges many words at once: their readings are scored together by a table."""
        new = set(words) - self.words.keys()
        if not new:
            return
        if len(self.words) > ROOM:
            self.words.clear()
            new = set(words)
        if self.table is None:
            self.table = Table(self.speech)
        every = list({x for w in new for x in (w, *undone(w).values(), *([w.lower()] if w.isupper() else ()))})
        scores = {}
        for at in range(0, len(every), 20_000):
            some = every[at : at + 20_000]
            scores.update((x, v + (self.rare if looks_utf8(x) else 0.0)) for x, v in zip(some, self.table.scores(some)))
        for w in new:
            self.judged(w, scores.__getitem__)

    def judged(self, word: str, proper) -> tuple[dict[str, tuple[float, str]], frozenset]:
        if len(self.words) > 2 * ROOM:
            self.words.clear()
        own = proper(word)
        if word.isupper():  # capitals alone are no sign of damage: as proper as the word in small letters, but for their share
            own = either(own, CAPITALS + proper(word.lower()))
        gains = {z: (proper(was) - own, was) for z, was in undone(word).items()}
        far = [c for c in word if c > "\x7f"]
        letters = len(set(far)) > 2 or sum(c.isalpha() for c in far) > 1 or MIXED.search(word) is not None
        have = self.words[word] = gains, frozenset(z for z, (gain, _) in gains.items() if gain > 0.0 and (letters or z.startswith("utf-8")))
        return have

    def proper(self, word: str) -> float:
        return self.speech.score(word) + (self.rare if looks_utf8(word) else 0.0)

    def prior(self, own: dict | None, size: float, chain: str) -> float:
        """Records of a source and field that came by the chain, leaning on all sources; before any were judged, the same for all sizes of source."""
        overall = (self.p.overall.get(chain, 0.0) + self.floor) / self.total
        return math.log(overall if own is None else (own.get(chain, 0.0) + 20.0 * overall) / (size + 20.0))

    def record(self, own: dict | None, size: float, words: list[str]) -> dict[str, float]:
        """Log posterior odds, against no damage, of each chain that makes any word more proper; chains that repair the record alike are one, under the likeliest.

        own, size: expected records by chain and records of the record's source and field.
        """
        found = self.evidence(words)
        priors = {z: self.prior(own, size, z) for z in found}
        odds = {z: priors[z] + gain for z, (gain, _) in found.items()}
        if len(odds) < 2:
            return odds
        out: dict[str, float] = {}
        seen: dict[tuple, str] = {}
        for z in sorted(odds, key=lambda z: (-priors[z], len(z), z)):
            first = seen.setdefault(found[z][1], z)
            out[first] = odds[z] if first == z else either(out[first], odds[z])
        return out

    def evidence(self, words: list[str]) -> dict[str, tuple[float, tuple]]:
        """The gain in log likelihood by each chain that makes any word more proper, whatever its prior, and the words as it repairs them.

        Damage comes in runs of words: a forward pass over the words that the chain
        could change, in the states whole and damaged, sums over all such runs.
        """
        known = self.words.get
        seen = [known(w) or self.word(w) for w in words]
        chains = set().union(*[tells for _, tells in seen if tells])
        out = {}
        for z in chains:
            whole, damaged, made = math.log(0.5), math.log(0.5), []
            for k, (gains, _) in enumerate(seen):
                if z in gains:
                    gain, was = gains[z]
                    whole, damaged = either(whole + STAY, damaged + SWITCH), either(damaged + STAY, whole + SWITCH) + gain
                    if gain > 0.0:
                        made.append((k, was))
            out[z] = either(whole, damaged), tuple(made)
        return out

    def repaired(self, chain: str, word: str) -> str:
        gain, was = self.word(word)[0].get(chain, (0.0, word))
        return was if gain > 0.0 else word


    def text(self, chain: str, text: str, words: list[str]) -> str:
        """The text with its damaged words read rightly: those that gain by it, or all where most others do."""
        better = sum(self.repaired(chain, w) != w for w in words)
        shift = _SHIFT.get(chain, {}) if 2 * better > len(words) else {}
        return WORDS.sub(lambda m: m[0] if m[0].isascii() else m[0].translate(shift) if shift and self.repaired(chain, m[0]) == m[0] else self.repaired(chain, m[0]), text)


class Table:
    """The character model as a table of the commonest letters: scores of many words at once, and a coarse test of them.

    Words with letters too rare for the table are scored one by one.
    """

    def __init__(self, speech: Speech, room: int = 1500):
        self.speech = speech
        known = sorted(speech.single, key=lambda c: (-speech.single[c], c))
        table = [START, *[c for c in known if c != START][: room - 1]]
        number = {c: i for i, c in enumerate(table)}
        none, rare = len(table), len(table) + 1
        ids = np.full(65536, none, np.int32)
        for c in known:
            if c < "\U00010000":
                ids[ord(c)] = number.get(c, rare)
        ids[ord(START)] = 0
        ids[65535] = rare  # letters beyond the basic plane
        share = np.array([speech.single.get(c, speech.other) for c in table] + [speech.other, 1.0])
        first = np.array([max(speech.first.get(c, 0.0), 0.0) for c in table] + [0.0, 0.0])
        self.cost = np.zeros((none + 2, none + 2)) + speech.back * share
        for ab, n in speech.pairs.items():
            if ab[0] in number and ab[1] in number:
                self.cost[number[ab[0]], number[ab[1]]] += max(n, 0.0)
        self.cost = np.log(self.cost / (first[:, None] + speech.back)) + 0.5 * np.log(share)
        self.cost[:, 0] = 0.0  # from one word to the next
        self.rare, self.ids, self.chains = rare, ids, []

    def laid(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code points of the words one after another, and where each begins."""
        codes = np.frombuffer("".join(START + w + END for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.minimum(codes, 65535), np.cumsum([0, *(len(w) + 2 for w in words)])[:-1]

    def score(self, seq: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.append(self.cost[seq[:-1], seq[1:]], 0.0), at)

    def scores(self, words: list[str]) -> list[float]:
        codes, at = self.laid(words)
        seq = self.ids[codes]
        out = self.score(seq, at).tolist()
        for k in np.flatnonzero(np.logical_or.reduceat(seq == self.rare, at)):
            out[k] = self.speech.score(words[k])
        return out

    def may_tell(self, words: list[str]) -> np.ndarray:
        """Which words a single-byte chain might make more proper.

        It passes every word that Judge.word would: those with UTF-8 sequences, those
        with letters too rare for the table, and those that score better in some page,
        whatever else a chain requires.
        """
        if not self.chains:
            for shift in _SHIFT.values():
                to = np.arange(65536)
                for a, b in shift.items():
                    to[a] = ord(b)
                self.chains.append(self.ids[to])
        codes, at = self.laid(words)
        own = self.ids[codes]
        pick = np.logical_or.reduceat(own == self.rare, at)
        least = self.score(own, at) + 1e-9
        for ids in self.chains:
            seq = ids[codes]
            pick |= (self.score(seq, at) > least) | np.logical_or.reduceat(seq == self.rare, at)
        return pick | np.array([ANY_RUN.search(w) is not None for w in words])


_JUDGES: dict[str, Judge] = {}


def judge_of(made: str, shared) -> Judge:
    """One judge for each worker and set of parameters."""
    if made not in _JUDGES:
        _JUDGES.clear()
        _JUDGES[made] = Judge(shared.value)
    return _JUDGES[made]


ODD_WORDS = re.compile(r"(?<![^ \t\r\n])[\x00-\x08\x0b\x0c\x0e-\x1f!-\x7f]*+[^\x00-\x7f][^ \t\r\n]*")


def odd_words(text: str) -> list[str]:
    """The words with anything beyond ASCII."""
    return ODD_WORDS.findall(text)


def declared_text(text: str) -> str:
    """A record's text as the record declares it: RTF by its header and escapes, other text as it stands."""
    return rtf_text(text) if is_rtf(text) else text


RECORDS = "doc_id string, node_id int, source string, field string, text string"


def declared(nodes: DataFrame) -> DataFrame:
    """Records whose text, as declared, has anything beyond ASCII."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [declared_text(t) for t in batch.column(4).to_pylist()]
            keep = [not t.isascii() for t in texts]
            b = batch.set_column(4, "text", pa.array(texts, pa.string()))
            yield b.filter(pa.array(keep, pa.bool_()))

    rows = nodes.where("tag in ('TextObject', 'RichObject') and doc_id is not null and node_id is not null").select("doc_id", F.col("node_id").cast("int").alias("node_id"), F.coalesce("form_code", F.lit("")).alias("source"), F.concat("tag", F.lit(".Text")).alias("field"), F.col("attrs")["Text"].alias("text"))
    odd = F.col("text").rlike(r"[^\x00-\x7F]") | ((F.col("field") == "RichObject.Text") & F.col("text").rlike(r"\\u-?[0-9]|\\'"))
    return rows.where("text <> ''").where(odd).mapInArrow(run, RECORDS)


def _stats(rows: list, names: tuple = ("kind", "a", "b", "c", "n")) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.string(), pa.float64()))], names=list(names))


STATS = "kind string, a string, b string, c string, n double"


SUSPECTS = RECORDS + ", size double"
#: Rows of expected records by source, field and chain up to which they are sent to every task; beyond, they are joined by a shuffle.
SENT = 200_000


def with_own(suspects: DataFrame, sums: DataFrame | None) -> DataFrame:
    """The suspects with the expected records of their source and field by chain, null before any round."""
    if sums is None:
        return suspects.withColumn("own", F.lit(None).cast("map<string,double>"))
    # A chain's sum in a source, not a record's share, may be too small to matter beside what the prior leans on.
    rows = sums.where("kind = 'chain' and n > 1e-4")
    own = rows.groupBy(F.col("a").alias("source"), F.col("b").alias("field")).agg(F.map_from_entries(F.collect_list(F.struct("c", "n"))).alias("own"))
    return suspects.join(F.broadcast(own) if rows.count() <= SENT else own, ["source", "field"], "left").select(*suspects.columns, F.coalesce("own", F.create_map().cast("map<string,double>")).alias("own"))


def estimate(records: DataFrame, rounds: int = 3, limit: int = 3_000_000) -> tuple[DataFrame, Params]:
    """Suspect records, each with the size and the expected records by chain of its source and field, and the parameters
    after ``rounds`` of expectation-maximisation over them.

    What comes to the driver are sums of bigrams of characters (bounded by the
    alphabets, ``limit`` at most) and of chains (bounded by the pages); sums by source
    stay with the executors.
    """
    run = uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: Counter = Counter()
        keys: Counter = Counter()
        for batch in batches:
            words: Counter = Counter()
            keys.update(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()))
            for text in batch.column(4).to_pylist():
                words.update(odd_words(text))
            for w, n in words.items():
                for ab in pairs_of(w):
                    pairs[ab] += n
        yield _stats([("pair", ab, "", "", float(n)) for ab, n in pairs.items()] + [("key", s, f, "", float(n)) for (s, f), n in keys.items()])

    summed = lambda stats: cut(stats.groupBy("kind", "a", "b", "c").agg(F.sum("n").alias("n")))
    sums = summed(records.mapInArrow(count, STATS))
    base = {r.a: r.n for r in collect_bounded(sums.where("kind = 'pair'"), limit, "the bigrams")}
    sizes = sums.where("kind = 'key'").select(F.col("a").alias("source"), F.col("b").alias("field"), F.col("n").alias("size"))
    total, n_keys = sizes.agg(F.coalesce(F.sum("size"), F.lit(0.0)), F.count("*")).first()
    words = sum(n for ab, n in base.items() if ab[1] == END)
    params = Params(base, {}, total, 1e-4)
    start = records.sparkSession.sparkContext.broadcast(params)

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = judge_of(f"{run}-0", start)
        table = judge.table = Table(judge.speech)
        tell: dict[str, bool] = {}
        for batch in batches:
            texts = batch.column(4).to_pylist()
            of = [odd_words(t) for t in texts]
            if len(tell) > ROOM:
                tell.clear()
            new = list({w for ws in of for w in ws} - tell.keys())
            for at in range(0, len(new), 10_000):
                some = new[at : at + 10_000]
                may = [w for w, m in zip(some, table.may_tell(some).tolist()) if m]
                judge.learn(may)
                # by likelihood alone: how likely a chain is in a source is for the rounds to tell
                tell |= dict.fromkeys(some, False) | {w: bool(judge.word(w)[1]) or looks_utf8(w) for w in may}
            keep = [LOST in t or any(map(tell.__getitem__, ws)) for t, ws in zip(texts, of)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    picked = records.mapInArrow(suspect, RECORDS)
    suspects = cut(picked.join(F.broadcast(sizes) if n_keys <= SENT else sizes, ["source", "field"]).select(*[c.split()[0] for c in SUSPECTS.split(", ")]))
    own = with_own(suspects, None)
    for no in range(1, rounds + 1):
        now = records.sparkSession.sparkContext.broadcast(params)

        def expect(batches: Iterator[pa.RecordBatch], now=now, no=no) -> Iterator[pa.RecordBatch]:
            judge = judge_of(f"{run}-{no}", now)
            pairs: Counter = Counter()
            chains: Counter = Counter()
            odd = 0.0
            for batch in batches:
                texts = batch.column(4).to_pylist()
                of = [odd_words(t) for t in texts]
                judge.learn(w for ws in of for w in ws)
                for s, f, size, own, words in zip(*(batch.column(i).to_pylist() for i in (2, 3, 5, 6)), of):
                    odds = judge.record(None if own is None else dict(own), size, words)
                    top = max([0.0, *odds.values()])
                    whole = math.exp(-top) + sum(math.exp(v - top) for v in odds.values())
                    for z, v in odds.items():
                        chains[s, f, z] += math.exp(v - top) / whole
                    shares = {z: math.exp(v - top) / whole for z, v in odds.items() if math.exp(v - top) / whole > 1e-4}
                    for w in words:
                        # the base counts hold every word as it stands: what is explained goes over to its original
                        moved = 0.0
                        for z, share in shares.items():
                            was = judge.repaired(z, w)
                            if was != w:
                                moved += share
                                for ab in pairs_of(was):
                                    pairs[ab] += share
                        for ab in pairs_of(w) if moved else ():
                            pairs[ab] -= moved
                        odd += 1.0 - moved if looks_utf8(w) else 0.0
            yield _stats([("pair", ab, "", "", n) for ab, n in pairs.items()] + [("chain", s, f, z, n) for (s, f, z), n in chains.items()] + [("odd", "", "", "", odd)])

        sums = summed(own.mapInArrow(expect, STATS))
        pairs = dict(base)
        odd = 0.0
        for r in collect_bounded(sums.where("kind <> 'chain'"), limit, "the bigrams"):
            if r.kind == "pair":
                pairs[r.a] = pairs.get(r.a, 0.0) + r.n
            else:
                odd = r.n
        overall = {r.c: r.n for r in sums.where("kind = 'chain'").groupBy("c").agg(F.sum("n").alias("n")).collect()}
        params = Params({k: v for k, v in pairs.items() if v > 1e-3}, overall, total, (odd + 0.5) / (words + 1e4))
        own = with_own(suspects, sums)
    return own, params


REPAIRS = "doc_id string, node_id int, field string, chain string, certainty double, recovered boolean, text string, repaired string"


def repair(nodes: DataFrame, rounds: int = 3) -> DataFrame:
    """The garbled records among all text and rich text objects, with their original text as far as it can be had.

    nodes: doc_id, node_id, tag, attrs, form_code. Output: one row for each garbled
    node with the chain of wrong readings (the last first; empty where only lost
    signs tell of it), its posterior, whether nothing was lost, the text as declared
    and the repaired text. Null and empty texts and plain ASCII give no rows;
    repeated rows of a node count once; a null form_code is a source of its own.
    """
    records = cut(declared(nodes))
    suspects, params = estimate(records, rounds)
    made = uuid.uuid4().hex
    final = nodes.sparkSession.sparkContext.broadcast(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = judge_of(f"{made}-end", final)
        for batch in batches:
            out = []
            texts = batch.column(4).to_pylist()
            of = [odd_words(t) for t in texts]
            judge.learn(w for ws in of for w in ws)
            for doc, node, f, size, own, text, words in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 5, 6)), texts, of):
                odds = judge.record(dict(own), size, words)
                chain, best = max(odds.items(), key=lambda x: x[1], default=(CLEAN, -math.inf))
                top = max([0.0, *odds.values()])
                sure = 1.0 - math.exp(-top) / (math.exp(-top) + sum(math.exp(v - top) for v in odds.values()))
                fixed = judge.text(chain, text, words) if sure > 0.5 else text
                if fixed != text or LOST in text:
                    out.append((doc, node, f, chain if fixed != text else CLEAN, max(sure, float(LOST in text)), LOST not in fixed, text, fixed))
            cols = list(zip(*out)) if out else [()] * 8
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.bool_(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "node_id", "field", "chain", "certainty", "recovered", "text", "repaired"])

    return suspects.mapInArrow(run, REPAIRS).dropDuplicates(["doc_id", "node_id"])
