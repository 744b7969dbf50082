"""Training-data operators against brute force, round trips and small fixtures, with nulls, empties, repeats and clashing names."""

import random
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventweave.llm import leaks, mixing, quantiles, truncation

random.seed(11)


# Percentiles


def test_codes_keep_order_and_values(spark):
    rng = np.random.default_rng(2)
    xs = np.concatenate([rng.normal(size=200) * 10.0 ** rng.integers(-30, 30, 200), [0.0, -0.0, 1.0, -1.0, np.inf, -np.inf, 5e-324, 2.0**-1022, 1.7976931348623157e308]])
    codes = quantiles.float_codes(xs)
    order = np.argsort(xs, kind="stable")
    assert (np.diff(codes[order]) >= 0).all() and (quantiles.code_values(codes, np.full(len(xs), quantiles.FLOAT)) == xs).all()
    rows = [(Decimal(t), b) for t, b in (("0.0001", 1), ("-0.0001", -1), ("99999999999999.9999", 2**63 - 1), ("-99999999999999.9999", -(2**63)), ("1234567890.1234", 7))] + [(None, None)]
    df = spark.createDataFrame(rows, "d decimal(18,4), b bigint")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    got = df.select("d", "b", quantiles.code(F.col("d"), kinds["d"])[0].alias("dc"), quantiles.code(F.col("b"), kinds["b"])[0].alias("bc")).collect()
    assert all((r.d is None and r.dc is None) or r.dc == int(r.d.scaleb(4)) for r in got) and all(r.b == r.bc for r in got)
    with pytest.raises(ValueError):
        quantiles.code(F.col("d"), T.DecimalType(20, 2))


def test_compress_keeps_counts_and_bound():
    rng = np.random.default_rng(4)
    node = np.unique(rng.integers(-(2**62), 2**62, 5000))
    n = rng.integers(1, 50, len(node))
    group = (np.arange(len(node)) % 2).astype("int64")
    keep = np.where(group == 0, n[group == 0].sum() // 100, 0)
    g, level, v, top, c = quantiles.compress(group, np.zeros(len(node), int), node, node, n, keep)
    for k in (0, 1):
        assert c[g == k].sum() == n[group == k].sum()
    assert (g == 1).sum() == (group == 1).sum() and (g == 0).sum() <= 3 * 100 and len(set(zip(g, level, v))) == len(g)
    inner = (level > 0) & (level < 63)
    assert (c[level > 0] <= keep.max()).all() and (top[inner] >= v[inner] << level[inner]).all() and (top[inner] < (v[inner] + 1) << level[inner]).all()


def _check_ranks(got, rows, eps):
    for r in got:
        have = np.sort([v for k, v in rows if k == r.k and v is not None])
        want = max(1, int(np.ceil(r.q * len(have) - 1e-9)))
        assert r.n == len(have) and r.rank_error <= eps * len(have) and r.value in have
        assert (have <= r.value).sum() >= want and (have < r.value).sum() < want + r.rank_error, r


@pytest.mark.parametrize("eps", [0.02, 0.2])
@pytest.mark.parametrize("kind", ["double", "decimal(18,4)", "bigint"])
def test_merged_percentiles_keep_the_rank_bound(spark, eps, kind):
    rng = np.random.default_rng(7)
    # Heavy tails, a narrow band of prices, one value alone, negative ones, and a group of fewer rows than the budget.
    x = {"tail": np.round(rng.pareto(1.1, 6000) * 100), "band": 1e4 + np.round(rng.normal(0, 40, 6000)), "one": np.full(500, 7.0), "minus": -np.round(rng.pareto(1.1, 4000) * 9), "few": rng.integers(0, 9, 40)}
    x[None] = np.concatenate([x["tail"][:2000], x["minus"][:2000]])
    rows = [(k, i % 5, float(v)) for k, vs in x.items() for i, v in enumerate(vs)] + [("gone", 1, None)]
    df = spark.createDataFrame(rows, "k string, day int, x double").withColumn("x", F.col("x").cast(kind)).withColumns({"node": F.lit(1), "n": F.lit(2), "field": F.lit("y"), "level": F.lit("z")})
    days = quantiles.digests(df, ["k", "day"], ["x"], eps)
    merged = quantiles.merge(quantiles.merge(days.where("day < 3"), ["k"], eps).unionByName(quantiles.merge(days.where("day >= 3"), ["k"], eps)), ["k"], eps)
    at = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = quantiles.quantiles(merged, ["k"], at, eps).collect()
    assert len(got) == 6 * len(at)
    # However often digests were merged and compressed.
    _check_ranks(got, [(k, v) for k, _, v in rows], eps)
    assert all(r.rank_error == 0 for r in got if r.k in ("one", "few"))
    assert quantiles.quantiles(quantiles.digests(df.limit(0), ["k"], ["x"]), ["k"], [0.5]).collect() == []


def test_long_groups_are_compressed_as_they_come(spark, monkeypatch):
    rng = np.random.default_rng(5)
    frames = [pd.DataFrame({"k": "a", "scale": 0, "level": 0, "node": v, "top": v, "n": 1}) for v in np.split(np.arange(60_000), 30)]
    monkeypatch.setattr(quantiles, "CHUNK", 5_000)
    out = pd.concat(list(quantiles._streams(iter(frames), ["k", "scale"], 300)))
    assert out["n"].sum() == 60_000 and len(out) <= 900 and (out["n"][out["level"] > 0] <= 200).all()


# Leaks


def _item(rng, n):
    return " ".join(f"{rng.choice('abcdefghij')}{rng.randint(0, 40)}" for _ in range(n))


def test_leaks(spark):
    rng = random.Random(3)
    shared = "Read the short scene below and reply with the sequence only."
    items = [(i, f"{shared} {_item(rng, 60).capitalize()}. {_item(rng, 20).capitalize()}?") for i in range(1, 9)] + [(90, None), (91, ""), (92, shared), (93, "Short one.")]
    words = lambda i: items[i - 1][1][len(shared) + 1 :].split()
    noise = lambda n: " ".join(f"n{rng.randint(0, 99)}" for _ in range(n))

    def altered(ws):
        return [("zz" if k % 16 == 7 else None if k % 16 == 15 else w) for k, w in enumerate(ws)]

    half = " ".join(w for w in altered(words(3)[:48]) if w)
    docs = [
        (1, f"{noise(50)} {' '.join(words(1))} {noise(50)}"), (2, f"{noise(5)} <p>{' '.join('**' + w.upper() + '**,' for w in words(2))}</p> &amp; {noise(5)}"), (3, f"{noise(30)}\n{half} {noise(9)}"),
        (4, f"{noise(30)} {' '.join(words(4)[:16])} {noise(30)}"), (5, f"{shared} {noise(80)}"), (6, None), (7, ""), (8, "   "), (9, noise(60_000) + " " + " ".join(words(5))),
        (10, " ".join(words(6)[:12] + noise(60).split() + words(6)[12:24] + noise(60).split() + words(6)[24:36])), (11, " ".join(words(7) + words(8))), (1, f"{noise(50)} {' '.join(words(1))}"),
    ]
    table = spark.createDataFrame(items, "item_id bigint, item_text string").withColumn("text", F.lit("x"))
    corpus = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"share": F.lit(1), "item_id": F.lit(2)})
    got = leaks.find_leaks(corpus, table).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (1, 1), (2, 2), (3, 3), (9, 5), (11, 7), (11, 8)]
    assert all(0.45 <= r.share <= 1 for r in got)
    assert leaks.find_leaks(corpus.limit(0), table).collect() == [] and leaks.find_leaks(corpus, table.limit(0)).collect() == []


def test_long_items_with_few_words_changed(spark):
    rng = random.Random(21)
    items = [(n, _item(rng, n).capitalize() + ".") for n in (300, 1200, 1500)]
    changed = lambda t, at: " ".join("zz" if i in at else w for i, w in enumerate(t.split()))
    docs = [(1, changed(items[0][1], (100, 200))), (2, changed(items[1][1], (500, 1000))), (3, changed(items[2][1], (500, 1000))), (4, "a a a " * 3000)]
    table = spark.createDataFrame([*items, (7, "a " * 4000 + ".")], "item_id bigint, item_text string")
    got = leaks.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), table).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 300), (2, 1200), (3, 1500), (4, 7)] and all(r.share == 1 for r in got)


def test_prints_of_every_long_shared_stretch():
    rng = np.random.default_rng(9)
    for _ in range(200):
        span = rng.integers(1, 50, leaks.K + leaks.WINDOW - 1)
        a = [rng.integers(50, 90, rng.integers(0, 9)), span, rng.integers(50, 90, rng.integers(0, 9))]
        b = [rng.integers(90, 99, rng.integers(0, 9)), span, rng.integers(90, 99, rng.integers(0, 9))]
        both = [np.concatenate(x).astype("uint64") for x in (a, b)]
        code, row = np.concatenate(both), np.repeat([0, 1], [len(x) for x in both])
        h, at = leaks.fingerprints(code, row)
        assert set(h[row[at] == 0]) & set(h[row[at] == 1])
        # Texts laid end to end leave what each leaves alone.
        for k in (0, 1):
            assert set(leaks.fingerprints(both[k], np.zeros(len(both[k]), int))[0]) == set(h[row[at] == k])
    for n in range(8):
        h, at = leaks.fingerprints(np.arange(1, n + 1).astype("uint64"), np.zeros(n, int))
        assert (len(h) > 0) == (n >= leaks.K)


def test_word_codes_part_words_like_text():
    texts = ["Größe_und <b>Maß</b> 42x", "", "größe UND maß", "a&amp;b … c—d 日本 e", "x" * 50]
    code, row = leaks.word_codes(texts)
    assert np.bincount(row, minlength=5).tolist() == [4, 0, 3, 6, 1]
    first = code[row == 0]
    assert (first[:3] == code[row == 2]).all() and len(set(code.tolist())) == 11
    assert len(leaks.word_codes([])[0]) == 0 and len(leaks.word_codes(["", "..."])[0]) == 0


def test_runs_are_the_same_by_pairs_and_by_diagonals(monkeypatch):
    rng = np.random.default_rng(3)
    a, b = rng.integers(1, 4, 60).astype("uint64"), rng.integers(0, 4, 90).astype("uint64")
    got = leaks.runs(a, b)
    monkeypatch.setattr(leaks, "PAIRS", 0)
    assert len(got) > 20 and (leaks.runs(a, b) == got).all()
    for i, j, n in got:
        assert (a[i : i + n] == b[j : j + n]).all() and (b[j : j + n] > 0).all()


def test_items_beyond_what_is_at_hand_give_the_same(spark, monkeypatch):
    rng = random.Random(31)
    items = [(i, _item(rng, 50).capitalize() + ". Same end.") for i in range(30)]
    docs = []
    for d in range(60):
        parts = [" ".join(w for w in items[rng.randrange(30)][1].split()[rng.randint(0, 20) : rng.randint(25, 52)] if rng.random() > 0.06) for _ in range(3)]
        docs.append((d, f" {_item(rng, 20)} ".join(parts)))
    args = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, item_text string")
    one = sorted(map(tuple, leaks.find_leaks(*args).collect()))
    monkeypatch.setattr(leaks, "AT_HAND", 0)
    assert len(one) > 30 and sorted(map(tuple, leaks.find_leaks(*args).collect())) == one
    # Every item against every whole text: what the fingerprints pass over has no such stretch.
    index = leaks.Index([(r.item_id, np.array(r.ws, "int64").view("uint64"), np.array(r.own)) for r in leaks.own_words(args[1]).collect()], 0.45, 0.125)
    brute = {(d, i) for d, text in docs for i, ws, own in index.items if leaks.extend(ws, own, leaks.word_codes([text])[0], 0.125) >= 0.5}
    assert brute <= {(d, i) for d, i, _ in one}


def test_prints_joined_by_shuffle_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(leaks, "AT_HAND", 0)
    rng = random.Random(5)
    items = [(i, _item(rng, 40).capitalize() + ".") for i in range(7)] + [(7, "Same text. " + _item(rng, 9)), (7, "Same")]
    docs = spark.createDataFrame([(i if i else None, "x y z " + t) for i, t in items], "doc_id bigint, text string")
    table = spark.createDataFrame(items, "item_id bigint, item_text string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = leaks.find_leaks(docs, table).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sorted((r.doc_id or 0, r.item_id) for r in got) == [(i, i) for i in range(7)]


# Mixing


def test_mix_meets_shares_caps_and_epochs(spark):
    rng = random.Random(8)
    docs = [(i, "big" if i % 3 else "mid", rng.randint(1, 40), rng.random()) for i in range(3000)] + [(5000 + i, "small", 10, None) for i in range(20)]
    docs += [(9000, None, 5, 1.0), (9001, "empty", 0, 1.0), (9002, "big", None, -1.0)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint, w double").withColumns({"key": F.lit(1), "bucket": F.lit(2), "rest": F.lit(3)})
    targets = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "mid", 0.3, 2), ("m", "small", 0.2, 7), ("n", "small", 0.9, 3), ("n", "empty", 0.1, 3), ("o", None, 1.0, 1), ("n", "none", 0.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    selection, report = mixing.mix(df, targets, weight="w")
    rows, shares = selection.collect(), {(r.mix_name, r.source): r for r in report.collect()}
    caps = {("m", "big"): 1, ("m", "mid"): 2, ("m", "small"): 7, ("n", "small"): 3}
    assert len({(r.mix_name, r.doc_id) for r in rows}) == len(rows)
    for k, cap in caps.items():
        mine = [r for r in rows if (r.mix_name, r.source) == k]
        copies = {r.copies for r in mine}
        assert max(copies) <= cap and max(copies) - min(copies) <= 1 and shares[k].most_copies == max(copies)
        assert sum(r.copies * r.n_tokens for r in mine) == shares[k].tokens and abs(shares[k].tokens - shares[k].budget) <= 40
    for s, want in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert shares["m", s].actual_share == pytest.approx(want, abs=0.02)
    assert shares["n", "small"].actual_share == 1.0 and shares["n", "empty"].tokens == 0 and shares["n", "small"].most_copies == 3
    total = mixing.mix(df, targets, weight="w", total_tokens=100)[1].where("mix_name = 'm'").agg(F.sum("tokens")).first()[0]
    assert 60 <= total <= 140
    again = {(r.mix_name, r.doc_id): r.copies for r in mixing.mix(df.repartition(7), targets, weight="w")[0].collect()}
    assert again == {(r.mix_name, r.doc_id): r.copies for r in rows}
    assert mixing.mix(df.limit(0), targets)[0].collect() == [] and mixing.mix(df, targets.limit(0))[1].collect() == []


def test_prefix_sums_equal_a_plain_sort_and_weights_matter(spark):
    docs = [(i, "s", 1 + i % 7, 5.0 if i % 2 else 0.2) for i in range(4000)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint, w double")
    targets = spark.createDataFrame([("m", "s", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    budget = 4000
    got = {r.doc_id for r in mixing.mix(df, targets, weight="w", total_tokens=budget)[0].collect()}
    keyed = df.select("doc_id", "n_tokens", mixing._key(F.col("doc_id"), F.lit("m"), F.col("w"), 17).alias("k")).orderBy("k", "doc_id").collect()
    want, total = set(), 0
    for r in keyed:
        if total + r.n_tokens <= budget or (total < budget and total + r.n_tokens - budget <= budget - total):
            want.add(r.doc_id)
        total += r.n_tokens
        if total >= budget:
            break
    assert got == want and sum(i % 2 for i in got) > 0.8 * len(got)


def test_token_counts_and_weights(spark):
    pytest.importorskip("tiktoken")
    rows = [(1, "Hello world, hello world!"), (2, None), (3, ""), (4, "é" * 20_000), (5, "<|endoftext|>")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in mixing.token_counts(df, doc_id="doc_id", text="text", keep=[]).collect()}
    assert got[1] == 6 and got[2] == got[3] == 0 and got[4] > 100 and got[5] > 1
    w = {r.doc_id: r.w for r in df.select("doc_id", mixing.quality_weight(F.col("text")).alias("w")).collect()}
    assert w[2] == w[3] == 0.1 and w[4] == 0.1 and 0.1 < w[1] < 0.3
    prose, table = "The late feed was quiet after lunch and nobody saw the gap until the next morning came round again in the hall. " * 2, "12 | 44 | 9\n" * 40
    w = [r.w for r in spark.createDataFrame([(prose,), (table,), (" \n",)], "t string").select(mixing.quality_weight(F.col("t")).alias("w")).collect()]
    assert w[0] > 0.9 and w[1] == w[2] == 0.1
    nulls = spark.createDataFrame([(None, "a b"), (2**60 + 1, "c")], "doc_id bigint, text string")
    assert {r.doc_id for r in mixing.token_counts(nulls, doc_id="doc_id", text="text", keep=[]).collect()} == {None, 2**60 + 1}


@pytest.mark.parametrize("weight", [0.1, 1e-9, 10.0])
def test_ranges_are_even_at_any_weight(spark, weight):
    docs = [(i, "s", 1 + i % 7, weight) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint, w double")
    targets = spark.createDataFrame([("m", "s", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    selection, report = mixing.mix(df, targets, weight="w", total_tokens=5000)
    assert abs(report.first().tokens - 5000) <= 4 and selection.agg(F.sum("n_tokens")).first()[0] == report.first().tokens
    key = mixing._key(F.col("doc_id"), F.lit("m"), F.col("w"), 17)
    sizes = df.withColumn("key", key).repartitionByRange(8, "key", "doc_id").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 3 * 3000 / 8


# Truncation

SUBJECTS = ["the reader", "a late gate", "the night desk", "our second feed", "the old clock"]
VERBS = ["counted", "forwarded", "rejected", "stored", "merged"]
OBJECTS = ["seventy stale prices", "every early beat", "nine empty lines", "the tagged records", "some vector values"]
ENDS = ["before the window closed", "while the sink was open", "because the key was missing", "until the operator came back"]


def _sentence(rng):
    return f"{rng.choice(SUBJECTS).capitalize()} {rng.choice(VERBS)} {rng.choice(OBJECTS)} {rng.choice(ENDS)}."


def _corpus(n=900):
    rng, docs, cut = random.Random(21), [], set()
    for i in range(n):
        source = ("chat", "mail", "notes", "wiki")[i % 4]
        text = " ".join(_sentence(rng) for _ in range(rng.randint(2, 12)))
        if source == "chat" and len(text) > 300:
            text = text[:300]
        elif source == "mail":
            text = text.replace(". ", ".\n", 2).replace("late", "läte")
            raw = text.encode()
            if len(raw) > 700:
                text = raw[:700].decode(errors="ignore")
            else:
                text += "\n[end of mail]" if i % 8 else ""
        elif source == "notes" and i % 3 == 0:
            text = text.rstrip(".")
        elif source == "wiki":
            tail = ["", "\n\n```\nif a:\n    run(a)\n```", "\n- open the window\n- read the report", "\n| a | b |\n| 12 | 14 |"][i // 4 % 4]
            text += tail
            if i % 40 == 3:
                text = text[: int(len(text) * 0.6)]
        docs.append((i, source, text))
    return docs, cut


def _ends_whole(text):
    return any(text.rstrip().endswith(e) or text.rstrip().endswith(e + ".") for e in ENDS) or text.rstrip().endswith(("```", "[end of mail]", "report", "|"))


def test_truncation_on_a_made_corpus(spark):
    docs, _ = _corpus()
    want = {i for i, _, t in docs if not _ends_whole(t)}
    rows = docs + [(5000, "chat", None), (5001, "chat", ""), (5002, None, "  "), (5003, None, _sentence(random.Random(1))), (5004, "wiki", "word " * 30_000 + ".")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumns({"cut": F.lit(1), "footer": F.lit("f"), "g1": F.lit("x"), "measure": F.lit("m"), "hash": F.lit(3), "tail": F.lit("]"), "src": F.lit("s")})
    got = truncation.find_truncated(df)[0].collect()
    assert len(got) == len(docs) + 2 and {c.doc_id for c in got}.isdisjoint({5000, 5001, 5002})
    found = {r.doc_id for r in got if r.cut}
    assert len(found & want) >= 0.95 * len(want) and len(found - want) <= 0.03 * len(want) + 2
    limits = {r.source: (r.measure, r.field_limit) for r in truncation.hidden_limits(df, source="source", text="text").collect()}
    assert limits["chat"] == ("chars", 300) and limits["mail"][1] == 700 and limits["mail"][0] == "utf8_bytes" and "notes" not in limits
    by_limit = {r.doc_id for r in got if r.reason == "limit"}
    assert by_limit == {r.doc_id for r in got if r.cut and r.at_limit} and len(by_limit) >= 50
    assert truncation.find_truncated(df.limit(0))[0].collect() == []


@pytest.mark.parametrize("most", [truncation.FILTER_MOST, 1 << 16])
def test_copies_of_a_text_vote_once(spark, monkeypatch, most):
    # With however few bits, the filter only drops less.
    monkeypatch.setattr(truncation, "FILTER_MOST", most)
    # A cut text whose last words end a sentence of the hot text and go on elsewhere; the hot text is the longest of its source.
    hot = "They went home. He sat by the old river. Nobody knew where the wide road. " + "x" * 300 + "."
    docs = [(i, "a", f"Item {w} was near the wide road {w} that day.") for i, w in enumerate("red blue green black white grey brown pink".split())]
    docs += [(20, "b", "Some men came. We saw it from the wide road")]
    docs += [(40 + i, "c", f"One {w} ran by.\n[end {w}]") for i, w in enumerate("fox hare deer mole".split())] + [(50, "c", hot)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    copies = spark.createDataFrame([(1000 + i // 2, ["c", "d"][i % 4 == 3], hot) for i in range(1000)], df.schema)
    verdicts = lambda d: {r.doc_id: (r.at_limit, r.cut) for r in truncation.find_truncated(d)[0].where("doc_id < 1000").collect()}
    alone, among = verdicts(df), verdicts(df.unionByName(copies))
    assert alone == among and len(alone) == len(docs) and alone[20] == (False, True)
    assert truncation.find_truncated(df.unionByName(copies))[0].count() == len(docs) + 1000
    limits = truncation.hidden_limits(df.unionByName(copies), source="source", text="text").collect()
    assert not {"c", "d"} & {r.source for r in limits}


def test_lengths():
    import html
    import json

    texts = ["a", "é𝄞<&>\"'\n\r\n\\t", "", "x\ty", "日本€ß", "plain"]
    for t, row in zip(texts, truncation.lengths(texts)):
        got = dict(zip(truncation.MEASURES, row.tolist()))
        lines = t.replace("\r\n", "\n").replace("\n", "\r\n")
        want = {
            "chars": len(t), "utf8_bytes": len(t.encode()), "utf16_units": len(t.encode("utf-16-le")) // 2, "latin1_bytes": len(t) + sum(c > "ÿ" for c in t), "html_chars": len(html.escape(t).replace("&#x27;", "&quot;")),
            "html_bytes": len(html.escape(t).replace("&#x27;", "&quot;").encode()), "json_chars": len(json.dumps(t, ensure_ascii=False)) - 2, "json_ascii": len(json.dumps(t)) - 2, "crlf_chars": len(lines), "crlf_bytes": len(lines.encode()),
        }
        assert got == want, t


def test_tails_and_blocks():
    assert truncation.strip_ellipsis("abc ... \n") == ("abc", True) and truncation.strip_ellipsis("abc.  \n") == ("abc.", False) and truncation.strip_ellipsis("abc…") == ("abc", True)
    assert truncation._tail("abc\n[end of the record]") == "[end of the record]" and truncation._tail("abc (more)") == "(more)" and truncation._tail("abc (more) x") is None
    assert truncation._open_block("x\n```\ncode") and truncation._open_block('x\n{"a": [1, 2') and not truncation._open_block("x\n```\ncode\n```")


def test_take_apart():
    took = truncation.take_apart(['He said "go". Then at 12:30, he left', "", " \n", "ZUD63 rose\n(see KEY-a12)\n* 4711 rows", "go. 7 ... x"])
    assert np.bincount(took.text, minlength=5).tolist() == [8, 0, 0, 6, 3]
    one = took.text == 0
    assert took.place[one].tolist() == [1, 2, 3, 1, 2, 3, 4, 5] and took.last[one].tolist() == [False, False, True, False, False, False, False, True] and took.stopped[one].tolist() == [False, False, True] + [False] * 5
    lines = took.text == 3
    assert took.place[lines].tolist() == [1, 2, 1, 2, 1, 2]
    word = lambda t: truncation.take_apart([t]).word.tolist()
    assert word("ZUD63") == word("gw-m18") != word("gw-m1") and word("4711") == word("1") != word("1,") and word("12:30") != word("12:3") and word("9.40") == word("123.55") != word("9.4")
    assert word("Go") == word("(go)") == word("go!") and word("go-it") != word("goit") and word("...") == [] and truncation.take_apart([]).word.tolist() == []
    # What a word alone leaves it leaves anywhere; places behind the seventh word are told apart.
    a, b = truncation.take_apart(["a b c d e f g h i"]), truncation.take_apart(["x. y", "a b c d e f g h i"])
    assert (a.grams() == b.grams()[2:]).all() and len(set(a.grams()[:, 0].tolist())) == 9


def test_marks_are_learned(spark):
    rng = random.Random(4)
    whole = [(i, "a", " ".join(_sentence(rng) for _ in range(4)) + (" (done)" if i % 5 == 0 else "")) for i in range(300)]
    cut = [(500 + i, "a", " ".join(_sentence(rng) for _ in range(3))[: 60 + 3 * i] + " [rest left out]") for i in range(20)]
    df = spark.createDataFrame(whole + cut, "doc_id bigint, source string, text string")
    got = {r.doc_id: r for r in truncation.find_truncated(df)[0].collect()}
    marked = [got[i] for i, _, t in cut if not _ends_whole(t[: -len(" [rest left out]")])]
    assert len(marked) > 10 and all(r.cut and r.reason == "mark" for r in marked) and not any(got[i].cut for i, *_ in whole)
