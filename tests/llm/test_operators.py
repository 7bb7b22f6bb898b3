"""Each operator against a brute-force version, on texts with every oddity."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tarnlake.llm import bitsliced, licenses, line_dedup, lm, mixing, ngram_join, packing, quality_model, quality_rules, suffix_dedup

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SPACE = " \t\n\v\f\r"


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def by_id(df, *columns):
    """doc_id -> sorted values, so that repeated rows compare too."""
    out = defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(tuple(r[c] for c in columns))
    return {k: sorted(v, key=repr) for k, v in out.items()}


def expected(rows, fn):
    out = defaultdict(list)
    for r in rows:
        out[r["doc_id"]].append(fn(r))
    return {k: sorted(v, key=repr) for k, v in out.items()}


# --- 1 ----------------------------------------------------------------------------------------------


def test_mix_targets_and_budgets(docs, rows):
    got = [r.asDict() for r in mixing.mix(docs).collect()]
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in rows)
    sizes, source = Counter(), {r["doc_id"]: r["source"] for r in rows}
    for r in rows:
        sizes[r["source"]] += len(split(r["text"]))
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in sizes if s not in capped)
        more = {s for s in sizes if s not in capped and level * weight[s] > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(3 * sizes[s] if s in capped else level * weight[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - int(3 * sizes[s] if s in capped else level * weight[s])) <= 1 for s in sizes)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(repr(r) for r in mixing.mix(docs).collect())


def test_mixed_documents_follow_what_is_taken(docs, rows):
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"]] += -(-r["taken"] // r["size"]) if r["size"] else 0
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({k: v for k, v in taken.items() if v})


# --- 2 ----------------------------------------------------------------------------------------------


def test_pack_holds_every_id_once(docs, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    pieces = [r.asDict() for r in packing.pack(docs.dropDuplicates(["doc_id"]), TOKENIZER).collect()]
    of = defaultdict(list)
    for p in pieces:
        of[p["doc_id"]].append(p)
    texts = {r["doc_id"]: r["text"] for r in rows}
    assert set(of) == set(texts)
    for doc, parts in of.items():
        ids = np.array([*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(parts, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    windows, padding = defaultdict(list), 0
    for p in pieces:
        windows[p["sequence_id"]].append(p)
    for parts in windows.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 2048 * docs.rdd.getNumPartitions()
    assert packing.pack(docs, TOKENIZER).count() >= len(rows)


# --- 3 ----------------------------------------------------------------------------------------------


def scan_by_hand(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), words


def notices_by_hand(words):
    found, best = set(), 0.0
    starts = range(0, max(0, len(words) - (licenses.BLOCK - licenses.STRIDE) - 1) + 1, licenses.STRIDE)
    for start in starts:
        block = set(words[start : start + licenses.BLOCK])
        for label, body in licenses.TEMPLATES:
            body = set(re.findall(r"[0-9a-z]+", body.lower()))
            share = len(block & body) / len(body)
            if share >= licenses.CONTAINMENT - 1e-9:
                found.add(label)
                best = max(best, share)
    return found, best


def test_words_are_encoded_as_by_the_tokenizer():
    """Words cut here, and words left to the tokenizer, alone and among others."""
    import random

    from tarnlake.llm.subwords import Encoder

    dice = random.Random(4)
    letters = [chr(i) for i in range(33, 127)] + list("''abstremvldé\x7f\x01İß\xa0\xadȺǅ¼²ªʼ中Σ\u0301ſ")
    made = ["".join(dice.choices(letters, k=dice.randint(1, 12))) for _ in range(3000)]
    made += ["<|startoftext|>", "x<|endoftext|>y", "<|ENDOFTEXT|>", "IT'S", "we'll'd", "e\u0301t\u0301"]
    encoder = Encoder(TOKENIZER)
    assert encoder.cut
    got = [encoder.split_ids([x])[0] for x in (made, [w.encode() for w in made])]
    want = np.concatenate([encoder.tokenizer.encode(w, add_special_tokens=False).ids for w in made])
    assert np.array_equal(got[0], want) and np.array_equal(got[1], want)


def test_license_scan(docs, rows):
    def hand(r):
        *base, words = scan_by_hand(r["text"])
        found, best = notices_by_hand(words)
        labels = sorted(found | ({*base[4].split(",")} - {""}))
        return (*base, ",".join(labels), 1.0 if base[1] else best)

    got = by_id(licenses.scan(docs), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    want = expected(rows, hand)
    assert got == want
    assert {r[5] for v in want.values() for r in v} >= {"apache,gpl,mit", "cc-by-nc", "mpl", ""}


# --- 4 ----------------------------------------------------------------------------------------------


def shingles(text, n):
    w = split(lower(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def groups_by_hand(rows, n, percent):
    sets = [shingles(r["text"], n) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r["doc_id"]), r["doc_id"])
    return [(len(sets[i]), least[find(i)]) for i in range(len(rows))]


@pytest.mark.parametrize("frequent, block", [(50, 1000), (3, 4)])
def test_ngram_groups(docs, rows, monkeypatch, frequent, block):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    want = defaultdict(list)
    for r, (n, c) in zip(rows, groups_by_hand(rows, 4, 85), strict=True):
        want[r["doc_id"]].append((n, c))
    got = by_id(ngram_join.link_groups(docs, 4, 85), "n_shingles", "component_id")
    assert got == {k: sorted(v, key=repr) for k, v in want.items()}


@pytest.mark.parametrize("block", [4, 1000])
def test_large_families_are_thinned_before_whole_sets_are_sent(spark, monkeypatch, block):
    common = [f"w{k}" for k in range(8)]
    texts = [" ".join([*common, *[f"a{i}x{k}" for k in range(12)]]) for i in range(12)]  # share frequent shingles only
    texts += [" ".join([*common, *[f"b{k}" for k in range(60)], f"end{i}"]) for i in range(6)]  # near copies
    rows = [{"doc_id": i, "text": t} for i, t in enumerate(texts)]
    for name, value in (("FREQUENT", 3), ("THIN_FROM", 0), ("BLOCK", block)):
        monkeypatch.setattr(ngram_join, name, value)
    sent, links = [], ngram_join._spread
    monkeypatch.setattr(ngram_join, "_spread", lambda m, *c: sent.append((c, links(m, *c))) or sent[-1][1])
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_groups(docs, 4, 85).collect()}
    assert got == dict(enumerate(groups_by_hand(rows, 4, 85)))
    assert [c[1] for c, _ in sent] == ["n", "shingles"]


def test_bounds_of_thinning_keep_every_link():
    dice = np.random.default_rng(3)
    sets = [np.unique(dice.integers(0, 1 << 60, 60).astype(np.uint64)) for _ in range(4)]
    sets += [np.unique(np.concatenate([s[k:], dice.integers(0, 1 << 60, k).astype(np.uint64)])) for s in sets[:3] for k in (1, 3, 5)]
    n = [len(s) for s in sets]
    frame = pd.DataFrame({"c": range(len(sets)), "n": n, "side": 0, "point": [ngram_join.point(s).tobytes() for s in sets],
                          "met": [s[: ngram_join.prefix_length(k, 85)].view(np.int64) for s, k in zip(sets, n, strict=True)]})
    found = {frozenset(p) for p in ngram_join._maybe(frame, 85)}
    assert all(not {3} & p for p in found)  # alone
    whole = pd.DataFrame({"c": range(len(sets)), "side": 0, "shingles": [s.tobytes() for s in sets]})
    group = list(range(len(sets)))
    for p in found:
        a, b = (group[i] for i in p)
        group = [b if g == a else g for g in group]
    assert all(group[u] == group[v] for u, v in ngram_join._links(whole, 85))


def test_one_of_each(docs, rows):
    want = sorted({r["doc_id"] for r, (n, c) in zip(rows, groups_by_hand(rows, 5, 80), strict=True) if c == r["doc_id"]})
    out = ngram_join.one_of_each(docs, 5, 80)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == want


# --- 5 ----------------------------------------------------------------------------------------------


def removed_by_hand(rows):
    seen = Counter()
    texts = [(r["text"] or "").encode() for r in rows]
    for t in texts:
        for i in range(len(t) - 199):
            seen[t[i : i + 200]] += 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        runs = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("shard", [1 << 20, 2000])
def test_suffix_dedup(docs, rows, monkeypatch, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    want = defaultdict(list)
    for r, v in zip(rows, removed_by_hand(rows), strict=True):
        want[r["doc_id"]].append(v)
    got = by_id(suffix_dedup.remove_repeats(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == {k: sorted(v, key=repr) for k, v in want.items()}


# --- 6 ----------------------------------------------------------------------------------------------


def test_classifier_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_model.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.9


def test_classifier_takes_any_table(docs, rows, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_model.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert quality_model.accepted(docs, labels).columns == docs.columns
    none = quality_model.classify(docs, labels.where("false")).collect()
    assert {r["score"] for r in none} == {0.5}


def test_quality_sample_is_bounded_by_rows(spark):
    """A labelled document on many rows counts once per text, and no more rows than asked are learnt from."""
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    once = [(i, f"{'good' if i % 2 else 'bad'} words of number {i}") for i in ids]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    fit = lambda rows, **k: quality_model.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels, **k)
    assert any(fit(once))
    assert fit(once + once[:1] * 300) == fit(once)
    many = [(ids[0], f"text {k} of one document") for k in range(50)]
    assert fit(many, max_rows=1) in {fit([r], max_rows=1) for r in many}


# --- 7 ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block, group", [(32_768, 512), (64, 2)])
def test_top_k(spark, monkeypatch, block, group):
    monkeypatch.setattr(bitsliced, "BLOCK_ROWS", block)
    monkeypatch.setattr(bitsliced, "QUERY_ROWS", group)
    dice = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in v], 1) for i, v in enumerate(dice.normal(0, 0.5, (300, 6)).round(1))]
    rows += [(400, [0.0] * 6, 1), (450, [float("nan")] * 6, 1), (451, None, 1), (None, [1.0] * 6, 1), (452, [None] * 6, 1), (453, [float("inf")] * 6, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    whole = {i: np.floor(256 * np.array(v, np.float32).astype(float)) for i, v, _ in rows[:301]}
    want = set()
    for q in whole:
        if q % 50 == 0:
            best = sorted((-int(whole[q] @ whole[c]), c) for c in whole if c != q)[:5]
            want |= {(q, r, c, -s) for r, (s, c) in enumerate(best, 1)}
    assert {tuple(r) for r in bitsliced.top_k(df, F.col("vec_id") % 50 == 0).collect()} == want
    assert bitsliced.top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    few = bitsliced.top_k(df.where("vec_id in (0, 1, 50)"), F.col("vec_id") % 50 == 0).collect()
    assert len(few) == 4


def test_top_k_of_any_finite_component_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(bitsliced, "BLOCK_ROWS", 40)
    dice = np.random.default_rng(2)
    rows = [(int(i), [float(np.float32(x)) for x in v]) for i, v in enumerate(dice.normal(0, 0.5, (160, 4)))]
    rows += [(200, [20_000.0, -1.0, 0.5, 0.0]), (201, [-20_000.0, 3.0, 1.0, 2.0]), (250, [1e25] * 4), (251, [-1e25, 1.0, 1.0, 1.0]), (252, [1.0])]
    rows += [rows[3]] * 6 + [rows[50]] * 2 + [(50, [0.25] * 4)]
    long = lambda x: max(-(2**63), min(2**63 - 1, x))
    whole = [(i, [long(int(np.floor(256 * float(np.float32(x))))) for x in v]) for i, v in rows]
    want = []
    for q, a in whole:
        if q % 50 == 0:
            best = sorted((-long(sum(x * y for x, y in zip(a, b, strict=False))), c) for c, b in whole if c != q)[:5]
            want += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in bitsliced.top_k(df, F.col("vec_id") % 50 == 0).collect()) == sorted(want)


# --- 8 ----------------------------------------------------------------------------------------------


def lines_by_hand(rows, least):
    """Kept text per (doc_id, text): a line goes if some run through it, of ``least`` words, stands earlier."""
    texts = sorted({(r["doc_id"], r["text"] or "") for r in rows})
    where, seq = {}, {}
    for doc, text in texts:
        lines = text.split("\n")
        seq[doc, text] = [(i, line, len(split(line))) for i, line in enumerate(lines) if split(line)]
    def runs(s):  # longer ones are made of these
        for a in range(len(s)):
            n = 0
            for b in range(a, min(len(s), a + 2 * least)):
                n += s[b][2]
                if n >= least:
                    yield a, b

    for key in texts:
        for a, b in runs(seq[key]):
            where.setdefault(tuple(x[1] for x in seq[key][a : b + 1]), (key, a))
    out = {}
    for key in texts:
        s, gone = seq[key], set()
        for a, b in runs(s):
            if where[tuple(x[1] for x in s[a : b + 1])] != (key, a):
                gone |= {x[0] for x in s[a : b + 1]}
        out[key] = "\n".join(line for i, line in enumerate(key[1].split("\n")) if i not in gone)
    return out


def test_line_dedup(docs, rows):
    want = expected(rows, lambda r, h=lines_by_hand(rows, 20): (h[r["doc_id"], r["text"] or ""] if r["text"] is not None else None,))
    assert by_id(line_dedup.dedup_lines(docs, 20), "text") == want
    out = line_dedup.without_copies(docs)
    assert out.columns == docs.columns
    assert all(r["n_chars"] == len(r["text"] or "") for r in out.collect())


# --- 9 ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("common", [1 << 20, 5])
def test_lm_base_and_proper_probabilities(docs, rows, monkeypatch, common):
    monkeypatch.setattr(lm, "COMMON_WORDS", common)
    tokens = lambda r: [*split(lower(r["text"])), " "]
    held = lambda r: zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2
    count = Counter(t for r in rows if not held(r) for t in tokens(r))
    n, v = sum(count.values()), len(count)

    def hand(r):
        t = tokens(r)
        return held(r), len(t), sum(count[x] > 0 for x in t), n, round(float(sum(np.log10((count[x] + 1) / (n + v + 1)) for x in t)), 6)

    got = lm.score(docs, TOKENIZER).withColumn("base_score", F.round("base_score", 6)).cache()
    assert by_id(got, "held_out", "n_tokens", "n_known", "train_tokens", "base_score") == expected(rows, hand)
    assert all(r["score"] < 0 for r in got.collect())


def test_lm_learns_from_every_id_of_a_training_text(docs, rows, monkeypatch):
    from tarnlake.llm.subwords import Encoder

    seen = []

    def train(texts, vocabulary, flat):
        seen.extend(np.frombuffer(r["ids"], "<u2") for r in texts.collect())
        return flat

    monkeypatch.setattr(lm, "train", train)
    lm.score(docs, TOKENIZER)
    encode, got, want = Encoder(TOKENIZER), [], Counter()
    windows = np.concatenate(list(lm.text_windows(np.concatenate(seen), np.array([len(t) for t in seen]), 7)))
    for w in windows.tolist():
        w = [i for i in w if i >= 0]
        assert 2 <= len(w) <= lm.WINDOW + 1
        if w[0] == lm.START:
            got.append(w)
        else:
            assert got[-1][-1] == w[0] and (len(got[-1]) - 1) % lm.WINDOW == 0
            got[-1] += w[1:]
    got = [tuple(w) for w in got]
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2:
            want[tuple([lm.START, *encode.split_ids([split(lower(r["text"]))])[0].tolist(), lm.END])] += 1
    assert Counter(got) == want and max(map(len, want)) > 9000


def test_lm_windows_score_each_token_once():
    dice = np.random.default_rng(2)
    counts = dice.integers(0, 50, lm.VOCABULARY).astype(float)
    words = lm.Vocabulary(counts)
    assert np.exp(words.inside).sum() == pytest.approx(lm.CLASSES)
    m = lm.unpack(lm.initial(counts, words))
    texts = [dice.integers(0, 49_000, n).astype("<u4") for n in (0, 1, 5, 31, 32, 33, 200)]
    for text, got in zip(texts, lm.text_scores(texts, m, words), strict=True):
        ids, want = [lm.START, *text.tolist(), lm.END], 0.0
        for i in range(1, len(ids)):
            k = 0 if i <= lm.WINDOW else -(-(i - lm.WINDOW) // (lm.WINDOW - lm.SHARED))
            context = ids[k * (lm.WINDOW - lm.SHARED) : i]
            hidden, _ = lm.attend(m, words.symbol[np.array([context])])
            logits = hidden[0, -1] @ m["output"] + m["bias"]
            want += logits[words.klass[ids[i]]] - np.log(np.exp(logits).sum()) + words.inside[ids[i]]
        assert got == pytest.approx(want / np.log(10), rel=1e-4)


def test_lm_model_is_not_cut():
    """Context of 7 ids at least and 32 at most, 24 ids with a class of their own and 24 shared classes."""
    assert (lm.WINDOW, lm.SHARED, lm.CLASSES) == (32, 6, 48)
    words = lm.Vocabulary(np.arange(lm.VOCABULARY, 0, -1).astype(float))
    sizes = np.bincount(words.klass, minlength=lm.CLASSES)
    assert len(sizes) == 48 and (sizes[:24] == 1).all() and (sizes[24:] > 1).all()


def test_lm_gradient_is_the_slope_of_the_loss():
    dice = np.random.default_rng(8)
    counts = dice.integers(1, 50, lm.VOCABULARY).astype(float)
    words = lm.Vocabulary(counts)
    ids = dice.integers(0, lm.VOCABULARY, (5, lm.WINDOW + 1))
    ids[1, 9:] = ids[3, 2:] = -1
    flat = lm.initial(counts, words).astype(np.float64)
    flat += dice.normal(0, 0.3, lm.LENGTH)

    def loss(at):
        m = lm.unpack(at)
        hidden, _ = lm.attend(m, words.symbol[np.maximum(ids[:, :-1], 0)])
        logits = hidden @ m["output"] + m["bias"]
        log_p = logits - np.log(np.exp(logits).sum(axis=2, keepdims=True))
        picked = np.take_along_axis(log_p, words.klass[np.maximum(ids[:, 1:], 0)][..., None], 2)[..., 0]
        return -picked[ids[:, 1:] >= 0].mean()

    g = lm.gradient(flat, ids, words)
    for name, slope in lm.unpack(g).items():
        for _ in range(3):
            way = np.zeros(lm.LENGTH)
            part = lm.unpack(way)[name]
            part[:] = dice.normal(size=part.shape)
            want = (loss(flat + 1e-5 * way) - loss(flat - 1e-5 * way)) / 2e-5
            assert (g * way).sum() == pytest.approx(want, rel=1e-3, abs=1e-6), name


def test_lm_replicas_learn_where_texts_stand_and_are_averaged(spark):
    dice = np.random.default_rng(9)
    texts = [dice.integers(0, 900, n).astype("<u2") for n in (0, 5, 70, 33, 400)]
    counts = np.bincount(np.concatenate(texts), minlength=lm.VOCABULARY).astype(float)
    words = lm.Vocabulary(counts)
    want = lm.initial(counts, words)
    tasks = [texts[:2], texts[2:]]
    df = spark.sparkContext.parallelize([[(0, bytearray(t.tobytes())) for t in own] for own in tasks], 2).flatMap(lambda rows: rows)
    df = spark.createDataFrame(df, "key long, ids binary")
    got = lm.train(df, words, want)
    for turn in range(lm.ROUNDS):
        sums, n = 0, 0
        for own in tasks:
            windows = np.concatenate(list(lm.text_windows(np.concatenate(own), np.array([len(t) for t in own]))))
            sums = sums + len(windows) * lm.learn(want, windows[np.random.default_rng(turn).permutation(len(windows))], words).astype(float)
            n += len(windows)
        want = (sums / n).astype(np.float32)
    assert np.allclose(got, want, atol=1e-5)


def test_lm_learns_nothing_from_an_empty_table(spark):
    counts = np.zeros(lm.VOCABULARY)
    start = lm.initial(counts, lm.Vocabulary(counts))
    assert np.array_equal(lm.train(spark.createDataFrame([], "key long, ids binary"), lm.Vocabulary(counts), start), start)


def test_lm_learns():
    dice = np.random.default_rng(4)
    step = dice.permutation(500)
    rows = [[int(dice.integers(500))] for _ in range(1500)]
    for r in rows:
        while len(r) <= lm.WINDOW:
            r.append(int(step[r[-1]]))
    windows = np.array(rows)
    counts = np.bincount(windows.ravel(), minlength=lm.VOCABULARY).astype(float)
    words = lm.Vocabulary(counts)
    start = lm.initial(counts, words)
    texts = [w.astype("<u4") for w in windows[:50]]
    before = lm.text_scores(texts, lm.unpack(start), words).mean()
    flat = start
    for _ in range(4):
        flat = lm.learn(flat, windows, words)
    assert lm.text_scores(texts, lm.unpack(flat), words).mean() > before * 0.8


# --- 10 ---------------------------------------------------------------------------------------------


def test_quality_rules(docs, rows):
    def hand(r):
        w, text = split(r["text"]), r["text"] or ""
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if split(x)]
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed

    got = quality_rules.judge(docs).cache()
    columns = "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    assert by_id(got, *columns) == expected(rows, hand)
    assert not [r for r in got.collect() if r["base_failed"] and r["kept"]]


def test_quality_rules_tell_junk(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_rules.judge(docs).join(labels, "doc_id").where("n_words >= 50").collect()
    good = [r["kept"] for r in got if r["quality"] == 1]
    bad = [r["kept"] for r in got if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.5


# --- all --------------------------------------------------------------------------------------------


def test_empty_tables(nothing, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mixing.mix(nothing).count() == mixing.mixed_documents(nothing).count() == 0
    assert packing.pack(nothing, TOKENIZER).count() == licenses.scan(nothing).count() == 0
    assert ngram_join.link_groups(nothing).count() == ngram_join.one_of_each(nothing).count() == 0
    assert suffix_dedup.remove_repeats(nothing).count() == line_dedup.without_copies(nothing).count() == 0
    assert quality_model.classify(nothing, labels).count() == quality_rules.judge(nothing).count() == 0
    assert lm.score(nothing, TOKENIZER).count() == 0


CLASHES = [
    "_hash", "_lines", "_id", "_h", "_gone", "_zz", "_t", "_times", "_s", "_z", "_key", "_k", "_own", "_stays", "_score", "row", "key", "key2", "doc", "c",
    "_n_lines", "_n_deleted", "_copies", "_epochs", "_reached", "a.b",
]


@pytest.mark.parametrize("stage", ["accepted", "without_copies", "one_of_each", "mixed_documents"])
def test_stages_leave_columns_of_any_name_alone(docs, spark, stage):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    named = plain.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    run = {
        "accepted": lambda d: quality_model.accepted(d, labels), "without_copies": line_dedup.without_copies,
        "one_of_each": lambda d: ngram_join.one_of_each(d, 5, 80), "mixed_documents": mixing.mixed_documents,
    }[stage]
    out = run(named)
    assert out.columns == named.columns
    got = [r.asDict() for r in out.collect()]
    assert all(r[c] == f"{c}{r['doc_id']}" for r in got for c in CLASHES)
    assert sorted(repr(r["doc_id"]) for r in got) == sorted(repr(r["doc_id"]) for r in run(plain).collect())


def test_stages_take_rows_without_an_id_and_one_row_many_times(docs, spark):
    few = docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id in (0, 1, 70)")
    text = few.where("doc_id = 0").first()["text"]
    more = spark.createDataFrame([(None, "no id " * 30, "en", "s", 180)], few.schema)
    copies = few.where("doc_id = 1").selectExpr("*", "explode(sequence(1, 10000)) AS x").drop("x")
    df = few.unionByName(more).unionByName(copies)
    once = ngram_join.one_of_each(df, 5, 80).collect()
    assert sorted(str(r["doc_id"]) for r in once if r["text"] != text) == sorted(["1", "None"] + (["70"] if few.where("doc_id = 70").first()["text"] != text else []))
    assert line_dedup.without_copies(df).where("doc_id = 1").select("text").distinct().count() == 1
    assert ngram_join.link_groups(df).where("doc_id = 1").count() == 10_001


def test_licenses_fold_ascii_letters_only(spark):
    body = next(body for _, body in licenses.TEMPLATES if "k" in body)
    texts = [(1, body.upper()), (2, body.replace("k", "\u212a"))]
    got = {r["doc_id"]: r["score"] for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[1] == 1.0 and got[2] < 1.0


def test_words_are_numbered_as_they_first_come():
    from tarnlake.llm.subwords import Lexicon

    lexicon = Lexicon(TOKENIZER, lm.word_hash)
    words = [b"zeta", b"alpha", b"zeta", b"don't", b"\xc3\xa9t\xc3\xa9", b"alpha1", b"\xc4\xb0x"]
    assert lexicon.numbers([words[:3], [], words[3:]]).tolist() == [0, 1, 0, 2, 3, 4, 5]
    assert lexicon.numbers([[b"new", b"alpha"]]).tolist() == [6, 1]
    assert lexicon.hashes.tolist() == [lm.word_hash(w) for w in [*dict.fromkeys(words), b"new"]]
    for number, word in enumerate([*dict.fromkeys(words), b"new"]):
        assert lexicon.subwords(np.array([number]))[0].tolist() == lexicon.encode.ids(word).tolist()


def test_hashing_a_batch_takes_little_memory():
    import tracemalloc

    import pyarrow as pa

    labels = [f"word{i} here" for i in range(40_000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": range(40), "text": [" ".join(labels[k * 1000 :][:4000]) for k in range(40)]})
    run = []

    class Docs:
        class sparkSession:  # noqa: N801
            class sparkContext:  # noqa: N801
                broadcast = staticmethod(lambda x: type("Held", (), {"value": x}))

        schema = __import__("pyspark").sql.types.StructType([])
        mapInArrow = staticmethod(lambda f, _: run.append(f))

    quality_model.score(Docs, bytes(4 * (quality_model.PLACES + 1)))
    list(run[0]([batch]))
    tracemalloc.start()
    rows = sum(len(b) for b in run[0]([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 40 and peak < 50e6
