"""Evaluation passages in training texts: winnowed word fingerprints, joined, and the hits extended where they lie.

Of the hashes of K words at each position, the least in each window of WINDOW positions is kept, so any shared stretch of
WINDOW + K - 1 words leaves the same fingerprint in both texts. Texts are taken apart in vectorized passes, however many items there are,
and only the surroundings of hits are compared word by word. Fingerprints of both sides are joined in one of two ways with the same
result: while all items together have up to AT_HAND words (counted first), each task has them at hand, the texts are read once and
nothing is shuffled; beyond, fingerprints, hits and the texts that have hits are joined by Catalyst.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from eventweave.session import materialise

K, WINDOW = 4, 3
#: Equal words that make a run in the extension of a hit, and the altered words that may lie between two runs.
RUN, GAP = 3, 8
#: Up to so many words of items in all are sent to every executor (17 bytes each, and half as many fingerprints); more are joined by shuffle.
AT_HAND = 4_000_000
#: Characters taken apart together.
CHARS = 1_000_000
#: Pairs of equal places compared at once; beyond, runs are found diagonal by diagonal.
PAIRS = 4_000_000
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|&(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);")
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+|\n+")
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def fold(text: str) -> str:
    """Lower case; markup becomes spaces, entities what they stand for."""
    if "<" in text or "&" in text:
        text = _TAG.sub(lambda m: html.unescape(m[0]) if m[0][0] == "&" else " ", text)
    return text.lower()


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x3000)), bool, 0x3000)


def _is_word(points: np.ndarray) -> np.ndarray:
    """Whether code points are letters or digits; all others part words."""
    out = _letters()[np.minimum(points, 0x2FFF)]
    if points.max(initial=0) >= 0x3000:
        high = points >= 0x3000
        seen, back = np.unique(points[high], return_inverse=True)
        out[high] = np.array([chr(c).isalnum() for c in seen.tolist()], bool)[back]
    return out


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    ones = lambda b: np.concatenate([[_U(1)], np.full((1 << bits) - 1, b, "uint64")]).cumprod(dtype="uint64")
    return ones(_U(_BASE)), ones(_U(pow(_BASE, -1, 1 << 64)))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def word_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of many texts, end to end, and the number of the text it is in.

    Word hashes are differences of one running polynomial over all characters, so there is no loop over words.
    """
    folded = [fold(t) for t in texts]
    points = np.frombuffer("\n".join([*folded, ""]).encode("utf-32-le", "surrogatepass"), "uint32")
    if not len(points):
        return np.zeros(0, "uint64"), np.zeros(0, "int64")
    power, inverse = _powers(max(20, int(len(points)).bit_length()))
    edge = np.diff(np.concatenate([[0], _is_word(points).view("int8")]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    upto = np.concatenate([[_U(0)], ((points.astype("uint64") + _U(1)) * power[: len(points)]).cumsum(dtype="uint64")])
    code = _mix((upto[end] - upto[start]) * inverse[start])
    code[code == 0] = 1  # nought stands for no word
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in folded), "int64", len(folded)))
    return code, np.searchsorted(ends, start, "right")


def fingerprints(code: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes of K words and the places of their first words, over texts end to end.

    Texts of fewer than WINDOW such hashes choose their least; those under K words none.
    """
    n = len(code) - K + 1
    if n < 1:
        return np.zeros(0, "uint64"), np.zeros(0, "int64")
    h = np.zeros(n, "uint64")
    for j in range(K):
        h = h * _U(_BASE) + code[j : j + n]
    h = _mix(h)
    whole = row[:n] == row[K - 1 :]
    far = np.concatenate([np.where(whole, h, _U(2**64 - 1)), np.full(WINDOW - 1, 2**64 - 1, "uint64")])
    view = np.lib.stride_tricks.sliding_window_view(far, WINDOW)
    least = np.arange(n) + WINDOW - 1 - view[:, ::-1].argmin(1)
    m = max(0, n - WINDOW + 1)
    chosen = whole & np.concatenate([[True], row[1:n] != row[: n - 1]])  # a text's first: its window may be cut short by the K - 1 places behind
    chosen[:m] |= whole[:m] & whole[WINDOW - 1 :] & (row[:m] == row[WINDOW - 1 : n])
    at = np.unique(least[chosen])
    return h[at], at


def _parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Stretches of texts of about CHARS characters."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHARS:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view("int64")


def _text_prints(batches: Iterator[pd.DataFrame], id_: str) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = pdf["text"].tolist()
        for a, z in _parts(texts):
            code, row = word_codes(texts[a:z])
            h, at = fingerprints(code, row)
            first = np.searchsorted(row, np.arange(z - a))
            mine = row[at]
            yield pd.DataFrame({id_: pdf[id_].iloc[a:z].iloc[mine].array, "h": pdf["h"].to_numpy()[a:z][mine], "j": at - first[mine], "print": _signed(h)})


def _sentences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for item, text in zip(pdf["item_id"], pdf["item_text"]):
            parts = _SENTENCE.split(text)
            code, row = word_codes(parts)
            for k in range(len(parts)):
                ws = code[row == k]
                if len(ws):
                    weights = np.arange(1, 2 * len(ws), 2).astype("uint64")
                    rows.append((item, k, int(_signed(_mix((ws * weights).cumsum(dtype="uint64")[-1:]))[0]), int(_signed((_mix(ws) * _mix(weights)).cumsum(dtype="uint64")[-1:])[0]), _signed(ws)))
        yield pd.DataFrame(rows, columns=["item_id", "k", "s1", "s2", "ws"])


def own_words(items: DataFrame) -> DataFrame:
    """(item_id, ws, own): each item's words, as hashes, and which belong to sentences that no other item has.

    Of rows with the same item_id the least text counts. Items without any own word are left out.
    """
    table = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("item_text").cast("string").alias("item_text"))
    table = table.where("item_id is not null and item_text is not null").groupBy("item_id").agg(F.min("item_text").alias("item_text"))
    parts = materialise(table.mapInPandas(_sentences, "item_id bigint, k int, s1 bigint, s2 bigint, ws array<bigint>"), "sentences")
    held = parts.groupBy("s1", "s2").agg((F.min("item_id") == F.max("item_id")).alias("own"))
    whole = parts.join(held, ["s1", "s2"]).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("k", "own", "ws"))).alias("p"))
    out = whole.select("item_id", F.flatten(F.col("p.ws")).alias("ws"), F.flatten(F.transform("p", lambda x: F.array_repeat(x["own"], F.size(x["ws"])))).alias("own"))
    return out.where(F.exists("own", lambda x: x))


def _own_prints(code: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of an item that hold an own word, and their places."""
    h, at = fingerprints(code, np.zeros(len(code), "int64"))
    upto = np.concatenate([[0], np.cumsum(own)])
    good = upto[at + K] > upto[at]
    return h[good], at[good]


def _need(n_own: int, share: float, altered: float) -> int:
    """Hits that a stretch of ``share`` of an item's own words has at least; see `_dense`."""
    return math.ceil((n_own * share * (1 - (K + WINDOW - 1) * altered) - (K + WINDOW - 2)) / WINDOW)


def _item_prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for item, ws, own in zip(pdf["item_id"], pdf["ws"], pdf["own"]):
            code, own = np.asarray(ws, "int64").view("uint64"), np.asarray(own, bool)
            h, at = _own_prints(code, own)
            yield pd.DataFrame({"item_id": item, "words": len(code), "n_own": int(own.sum()), "i": at, "print": _signed(h)})


def _near(ws: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """The words within any of the spans, stretches apart by words that equal none."""
    out: list[np.ndarray] = []
    end = -1
    for lo, hi in sorted((max(0, lo), min(len(ws), hi)) for lo, hi in spans):
        if lo > end and out:
            out.append(np.zeros(GAP + 2, "uint64"))
        if hi > max(lo, end):
            out.append(ws[max(lo, end) if end >= lo else lo : hi])
            end = hi
    return np.concatenate(out) if out else np.zeros(0, "uint64")


def _surroundings(batches: Iterator[pd.DataFrame], id_: str) -> Iterator[pd.DataFrame]:
    """For each row and item hit the words around its hits."""
    for pdf in batches:
        texts = pdf["text"].tolist()
        for a, z in _parts(texts):
            rows = []
            code, row = word_codes(texts[a:z])
            first = np.searchsorted(row, np.arange(z - a + 1))
            for t in range(a, z):
                spans = defaultdict(list)
                for x in pdf["hits"].iloc[t]:
                    spans[x["item_id"]].append((x["lo"], x["hi"]))
                for item, got in spans.items():
                    rows.append((pdf[id_].iloc[t], item, _signed(_near(code[first[t - a] : first[t - a + 1]], got))))
            yield pd.DataFrame(rows, columns=[id_, "item_id", "near"])


def _dense(hits: DataFrame, share: float, altered: float) -> DataFrame:
    """(id, h, hits) of the texts in which an item's hits lie close enough together, hits being spans of words around them.

    A stretch of L words of the item of which a share of ``altered`` is altered has at least (L * (1 - 6 * altered) - 5) / 3 hits: each altered
    word parts two unaltered runs, and a run of R words keeps (R - 5) / 3 fingerprints. The places of a stretch's hits differ, between
    text and item, by no more than the altered words, so hits are counted in bins of that width and each is taken with its neighbours.
    """
    width = F.ceil(F.col("words") * altered).cast("int") + GAP
    binned = hits.withColumn("bin", F.floor((F.col("j") - F.col("i")) / width).cast("int")).groupBy("id", "h", "item_id", "words", "n_own", "bin").agg(F.size(F.collect_set("i")).alias("n"))
    by = W.partitionBy("id", "h", "item_id").orderBy("bin")
    around = F.greatest(F.sum("n").over(by.rangeBetween(-1, 0)), F.sum("n").over(by.rangeBetween(0, 1)))
    need = F.ceil((F.col("n_own") * share * (1 - (K + WINDOW - 1) * altered) - (K + WINDOW - 2)) / WINDOW)
    near = binned.withColumn("around", around).where(F.col("around") >= need)
    span = F.struct("item_id", ((F.col("bin") - 1) * width).alias("lo"), ((F.col("bin") + 2) * width + F.col("words")).alias("hi"))
    return near.groupBy("id", "h").agg(F.collect_list(span).alias("hits"))


def triples(ws: np.ndarray) -> np.ndarray:
    """A hash for each RUN successive words; nought where one of them is no word."""
    if len(ws) < RUN:
        return np.zeros(0, "uint64")
    h = _mix((ws[:-2] * _U(_BASE) + ws[1:-1]) * _U(_BASE) + ws[2:])
    h[(ws[:-2] == 0) | (ws[1:-1] == 0) | (ws[2:] == 0)] = 0
    return h


def runs(item: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Maximal runs of RUN equal words or more, as rows of (place in item, place in text, length), in order of the text."""
    a, b = triples(item), triples(doc)
    if not len(a) or not len(b):
        return np.zeros((0, 3), "int64")
    order = np.argsort(b, kind="stable")
    left, right = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    many = right - left
    if many.sum() <= PAIRS:
        i = np.repeat(np.arange(len(a)), many)
        j = order[np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(left, many)]
        by = np.lexsort((i, j - i))
        i, j = i[by], j[by]
        head = np.ones(len(i), bool)
        head[1:] = (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)
        start = np.flatnonzero(head)
        found = np.stack([i[start], j[start], np.diff(np.append(start, len(i))) + RUN - 1], 1)
    else:
        some = []
        for d in range(-(len(a) - 1), len(b)):
            lo, hi = max(0, -d), min(len(a), len(b) - d)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], (a[lo:hi] == b[lo + d : hi + d]).view("int8"), [0]])))
            some += [(lo + s, lo + s + d, e - s + RUN - 1) for s, e in zip(edge[::2].tolist(), edge[1::2].tolist())]
        found = np.array(some, "int64").reshape(-1, 3)
    return found[np.lexsort((found[:, 0], found[:, 1]))]


def extend(item: np.ndarray, own: np.ndarray, doc: np.ndarray, altered: float) -> float:
    """Largest share of the item's own words that one stretch of the text covers in order.

    A stretch is a chain of runs that go forward in both, with up to GAP altered words between; an equal word counts 2 * altered, one
    altered or missing 1 - 2 * altered against it, and a chain begins anew where nothing is left of what came before.
    """
    upto = np.concatenate([[0], np.cumsum(own)])
    for_equal, against = 2 * altered, 1 - 2 * altered
    ends: dict[int, list[tuple[int, int, float]]] = defaultdict(list)
    top = 0
    for i, j, n in runs(item, doc).tolist():
        first, score = i, for_equal * n
        for end in range(j - GAP, j + 2):
            for past, begun, had in ends.get(end, ()):
                gi, gj = i - past, j - end
                if -1 <= gi <= GAP and abs(gi - gj) <= GAP // 2:
                    got = had + for_equal * (n + min(gi, gj, 0)) - against * max(gi, 0)
                    if had - against * max(gi, 0) >= 0 and got > score:
                        first, score = begun, got
        ends[j + n].append((i + n, first, score))
        top = max(top, int(upto[i + n] - upto[first]))
    return top / int(upto[-1])


def covered(item: np.ndarray, own: np.ndarray, doc: np.ndarray, share: float, altered: float) -> float:
    """What `extend` gives, or 0 where that can't reach ``share``: own words outside common triples are in no run."""
    common = np.flatnonzero(np.isin(triples(item), triples(doc)))
    held = np.zeros(len(own), bool)
    for d in range(RUN):
        held[common + d] = True
    return extend(item, own, doc, altered) if (held & own).sum() >= share * (1 - 2 * altered) * own.sum() else 0.0


class Index:
    """Words and fingerprints of all items, for tasks that have them at hand."""

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray]], share: float, altered: float) -> None:
        self.items, self.share, self.altered = items, share, altered
        self.width = np.array([math.ceil(len(ws) * altered) + GAP for _, ws, _ in items])
        self.need = np.array([_need(int(own.sum()), share, altered) for *_, own in items])
        parts = [(*_own_prints(ws, own), k) for k, (_, ws, own) in enumerate(items)]
        prints = np.concatenate([h for h, _, _ in parts])
        order = np.argsort(prints, kind="stable")
        self.prints, self.place = prints[order], np.concatenate([at for _, at, _ in parts])[order]
        self.item = np.repeat([k for *_, k in parts], [len(h) for h, *_ in parts])[order]

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, float]]:
        """(number of the text, item, share) of all leaks."""
        code, row = word_codes(texts)
        h, at = fingerprints(code, row)
        left = np.searchsorted(self.prints, h, "left")
        many = np.searchsorted(self.prints, h, "right") - left
        if not many.sum():
            return
        x = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(left, many)
        at = np.repeat(at, many)
        first = np.searchsorted(row, np.arange(len(texts) + 1))
        text, item, place = row[at], self.item[x], self.place[x]
        bins = (at - first[text] - place) // self.width[item]
        # Hits by text, item and bin, each place of the item once.
        order = np.lexsort((place, bins, item, text))
        text, item, bins, place = text[order], item[order], bins[order], place[order]
        step = np.ones(len(text), bool)
        step[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (bins[1:] != bins[:-1])
        new = step.copy()
        new[1:] |= place[1:] != place[:-1]
        start = np.flatnonzero(step)
        n = np.add.reduceat(new.astype("int64"), start)
        text, item, bins = text[start], item[start], bins[start]
        next_to = (text[1:] == text[:-1]) & (item[1:] == item[:-1]) & (bins[1:] == bins[:-1] + 1)
        best = n.copy()
        best[1:] = np.maximum(best[1:], n[1:] + n[:-1] * next_to)
        best[:-1] = np.maximum(best[:-1], n[:-1] + n[1:] * next_to)
        good = np.flatnonzero(best >= self.need[item])
        spans: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for t, k, b in zip(text[good].tolist(), item[good].tolist(), bins[good].tolist()):
            w = int(self.width[k])
            spans[t, k].append(((b - 1) * w, (b + 2) * w + len(self.items[k][1])))
        for (t, k), got in spans.items():
            id_, ws, own = self.items[k]
            share = covered(ws, own, _near(code[first[t] : first[t + 1]], got), self.share, self.altered)
            if share >= self.share:
                yield t, id_, share


def find_leaks(
    docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", share: float = 0.45, altered: float = 0.125,
) -> DataFrame:
    """(doc_id, item_id, share DOUBLE): each text that holds at least ``share`` of an item's own words in one stretch, in order.

    ``items`` has item_id and item_text. Up to ``altered`` of the words may be replaced or missing, and as many again are forgiven in
    short stretches; more than GAP altered words in a row end a stretch. Null and empty texts hold nothing; items without a sentence of
    their own can't leak; items without ``K`` words or empty tables give no rows. Rows repeat as the documents' rows do: one per row of
    ``docs`` and item. Texts and items are taken whole, whatever their length. Other columns are ignored.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[doc_id]
    # Ids travel as text: pandas would make floats of integers beside nulls.
    schema = "id string, item_id bigint, share double"
    out = lambda df: df.select(F.col("id").cast(kind).alias(doc_id), "item_id", "share")
    known = materialise(own_words(items), "items")
    texts = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).cast("string").alias("text")).where(F.length("text") > 0)
    size = known.agg(F.sum(F.size("ws"))).first()[0]
    if size is None:
        return out(spark.createDataFrame([], schema))
    if size > AT_HAND:
        return out(_by_join(texts, known, schema, share, altered))
    rows = known.sort("item_id").collect()
    index = spark.sparkContext.broadcast([(r.item_id, np.array(r.ws, "int64").view("uint64"), np.array(r.own, bool)) for r in rows])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = Index(index.value, share, altered)
        for pdf in batches:
            ids, all_texts = pdf["id"], pdf["text"].tolist()
            for a, z in _parts(all_texts):
                got = list(made.search(all_texts[a:z]))
                yield pd.DataFrame({"id": ids.iloc[[a + t for t, *_ in got]].array, "item_id": [i for _, i, _ in got], "share": [s for *_, s in got]})

    return out(texts.mapInPandas(search, schema))


def _by_join(texts: DataFrame, known: DataFrame, schema: str, share: float, altered: float) -> DataFrame:
    """The same for items of any size: fingerprints joined, hits counted and surroundings measured by shuffles."""
    prints = materialise(known.mapInPandas(_item_prints, "item_id bigint, words int, n_own int, i int, print bigint"), "prints")
    texts = texts.select("id", F.xxhash64("text").alias("h"), "text")
    made = texts.mapInPandas(lambda b: _text_prints(b, "id"), "id string, h bigint, j int, print bigint")
    # Rows of one id and text have the same hits: told by the text's hash, so that rows that repeat an id with another text stay apart.
    hits = materialise(_dense(made.join(prints, "print"), share, altered), "hits").withColumnsRenamed({"id": "id2", "h": "h2"})
    hit = texts.join(hits, (texts["h"] == hits["h2"]) & texts["id"].eqNullSafe(hits["id2"])).select("id", "text", "hits")
    near = hit.mapInPandas(lambda b: _surroundings(b, "id"), "id string, item_id bigint, near array<bigint>")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            view = lambda x: np.asarray(x, "int64").view("uint64")
            got = np.array([covered(view(ws), np.asarray(own, bool), view(doc), share, altered) for ws, own, doc in zip(pdf["ws"], pdf["own"], pdf["near"])], float)
            keep = got >= share
            yield pd.DataFrame({"id": pdf["id"][keep], "item_id": pdf["item_id"][keep], "share": got[keep]})

    return near.join(known, "item_id").select("id", "item_id", "ws", "own", "near").mapInPandas(measure, schema)
