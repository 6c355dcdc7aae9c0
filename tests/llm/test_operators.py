import base64
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weft.llm import ann, chat, common, kernels, lattice, linededup, minhash, mixing, packing, quality, sharding, simjoin, warc
from weft.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def empty(df):
    return df.filter("false")


# 1 mixing
def targets(sizes, most=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: k % 3 + 1 for k, s in enumerate(names)}
    out, left, total = {}, set(names), float(sum(sizes.values()))
    while left:
        share = (total - sum(out.values())) / sum(w[s] for s in left)
        over = [s for s in left if share * w[s] > most * sizes[s]]
        if not over:
            return out | {s: share * w[s] for s in left}
        for s in over:
            out[s] = float(most * sizes[s])
            left.discard(s)
    return out


def test_mixing(documents):
    rows, chosen = mixing.mix(documents)
    got = chosen.collect()
    assert len(got) == documents.count()
    sizes = defaultdict(int)
    for r in documents.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    want, taken = targets(sizes), defaultdict(int)
    largest = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    again = mixing.mix(documents.repartition(3))[1].collect()
    key = lambda r: (r.doc_id, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))
    mixed = mixing.mixed_documents(documents)
    assert mixed.columns == documents.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix(empty(documents))[1].count() == 0
    assert mixing.mixed_documents(empty(documents)).count() == 0


def pareto(rows, most=3):
    """Copies of each unit hash, chosen one by one: whole copies, then lowest odds ratios, then two fillers a source."""
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
    want, out = targets(sizes, most), {}
    for s in sizes:
        own = [r for r in rows if r.source == s]
        weight = {r.h: 1 + math.floor(math.log2(r.size + 1)) / 16 for r in own}
        lo, hi = 0.0, float(most)  # expected copies c * weight, at most ``most``, fill the target
        for _ in range(200):
            c = (lo + hi) / 2
            lo, hi = (c, hi) if sum(min(most, c * weight[r.h]) * r.size for r in own) < want[s] else (lo, c)
        copies = {r.h: min(float(most), hi * weight[r.h]) if r.size else 0.0 for r in own}
        take = {h: math.floor(x + 1e-6) for h, x in copies.items()}
        rest = want[s] - sum(take[r.h] * r.size for r in own)
        ranked = []
        for r in own:
            p, u = copies[r.h] - take[r.h], (((r.h % 2**64) >> 11) + 0.5) / 2**53
            if p > 1e-6:
                ranked.append((u / (1 - u) / (p / (1 - p)), r.h, r.size))
        ranked.sort()
        for k, (_, h, size) in enumerate(ranked):
            if size > rest:
                break
            take[h] += 1
            rest -= size
        else:
            k = len(ranked)
        left = ranked[k:]
        for _ in range(2):
            best = min(((abs(z - rest), z, h) for _, h, z in left if abs(z - rest) < rest), default=None)
            if best:
                take[best[2]] += 1
                rest -= best[1]
                left = [x for x in left if x[1] != best[2]]
        out |= take
    return out


def test_mixing_chooses_as_pareto_order_sampling(spark):
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(["w"] * int(rng.integers(1, 90))), f"s{k % 4 if k % 5 else 0}") for k in range(600)]
    units, chosen = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    want = pareto(units.collect())
    of = {r.doc_id: r.h for r in units.collect()}
    got = {of[r.doc_id]: r.copies for r in chosen.collect()}
    assert sum(got[h] != want[h] for h in want) <= 4  # a tie of rounding moves a few


def test_mixing_of_repeated_and_null_rows(spark):
    rows = [(k, " ".join(["w"] * (k % 40 + 1)), "s1") for k in range(300)] + [(900, " ".join(["x"] * 55), "s1")] * 200
    rows += [(None, "a b c", "s2")] * 50 + [(None, None, None)] * 3 + [(k, "d " * 30, "s3") for k in range(500, 600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(docs)[1].collect()
    assert len(got) == len(rows)
    for s in ("s1", "s2", "s3"):
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 55 and all(r.taken <= 3 * r.size for r in own)
    mixed = mixing.mixed_documents(docs).collect()
    want = Counter()
    for r in got:
        want[r.doc_id, r.source] += r.copies
    assert Counter((r.doc_id, r.source) for r in mixed) == +want
    assert sorted((str(r.doc_id), r.copies) for r in mixing.mix(docs.repartition(7))[1].collect()) == sorted((str(r.doc_id), r.copies) for r in got)


# 2 chat
def test_chat(spark):
    control = [*chat.CONTROL, "\\", "<", "a", "é☕", " [/INST]", "\n"]
    rng = np.random.default_rng(0)
    rows = [(c, t, ["user", "assistant", "system", None, "[INST]"][rng.integers(5)], "".join(rng.choice(control, 5)) if rng.random() < 0.9 else None) for c in range(40) for t in range(int(rng.integers(1, 9)))]
    rows += [(None, 0, "user", "x"), (50, None, "assistant", "n"), (50, 1, "assistant", "m"), (50, 1, "assistant", "m")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS blocks", "2 AS segments")
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    out = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.digests(out).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].n_blocks == len(list(itertools.groupby(turns, key=lambda t: t[1])))
    assert out.filter("formatted <> array_join(transform(segments, s -> s.text), '')").count() == 0
    assert chat.digests(chat.format_conversations(empty(df))).count() == 0


# 3 sharding
def test_feistel():
    for n in (1, 2, 3, 100, 1025):
        p = sharding.Feistel(n, 5)
        y = p.forward(np.arange(n))
        assert sorted(y) == list(range(n)) and (p.inverse(y) == np.arange(n)).all()
    s, slot = sharding.locate(np.arange(100), 100, 8, 3)
    assert (sharding.unlocate(s, slot, 100, 8, 3) == np.arange(100)).all()


def test_sharding(documents):
    got = sharding.shard(documents).collect()
    text = {r.doc_id: (r.text or "").encode() for r in documents.collect()}
    assert len(got) == documents.count()
    by = defaultdict(list)
    for r in got:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id]), "rows", None)
        by[r.shard].append(r.slot)
    assert set(by) == set(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    again = sharding.shard(documents.repartition(5)).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in got) == sorted((r.doc_id, r.shard, r.slot) for r in again)
    assert sharding.shard(empty(documents)).count() == 0


# 4 packing
def test_knapsack_and_patterns():
    rng = np.random.default_rng(1)
    lengths, values = np.array([3, 5, 7]), np.array([4.0, 7.0, 9.0])
    best, counts = packing.price(lengths, values, 16)
    brute = max(sum(v * k for v, k in zip(values, c, strict=True)) for c in itertools.product(range(6), repeat=3) if sum(n * k for n, k in zip(lengths, c, strict=True)) <= 16)
    assert best == pytest.approx(brute) and (counts * values).sum() == pytest.approx(brute)
    for n in (5, 200, 5000):
        l, d = np.unique(rng.integers(1, 250, n), return_counts=True)
        p = packing.cutting_stock(l, d, 256)
        assert (sum(c * a for c, a in p) == d).all() and all((a * l).sum() <= 256 for _, a in p)
    assert sum(c for c, _ in p) <= 1.03 * (l * d).sum() / 256 + 1


def test_encoder_is_the_tokenizer():
    from tokenizers import Tokenizer

    path = tokenizer_path()
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    rng = np.random.default_rng(2)
    ok = [*map(chr, range(0x250)), *"–’“€"]
    texts = [p.replace("_", c) for c in ok for p in ("_", "a_b", " _ ", "_'s", "1_2", "\n_\n", "  _")]
    texts += ["".join(rng.choice(ok, 50)) for _ in range(500)] + ["<|endoftext|> x", "日本語", " " * 900 + "x", "a" * 9000, ""]
    for x in texts:
        assert packing.encoder(path)(x).tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_packing(documents):
    path = tokenizer_path()
    got = packing.pack(documents, path).collect()
    enc = packing.encoder(path)
    ids = {r.doc_id: np.append(enc(r.text or ""), 0).astype("<u4") for r in documents.collect()}
    seen, seqs = Counter(), defaultdict(list)
    for r in got:
        x = ids[r.doc_id]
        assert r.doc_tokens == len(x) and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        seen[r.doc_id] += r.length
        seqs[r.sequence_id].append((r.offset, r.length))
    times = Counter(r.doc_id for r in documents.select("doc_id").collect())
    assert seen == Counter({d: len(ids[d]) * n for d, n in times.items()})
    for v in seqs.values():
        v.sort()
        assert v[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:], strict=False)) and sum(n for _, n in v) <= 1024
    total = sum(seen.values())
    assert len(seqs) <= -(-total // 1024) + 3
    assert packing.pack(empty(documents), path).count() == 0


# 5 lattice
def test_lattice_is_the_sum_over_segmentations():
    p = lattice.Pieces.load(tokenizer_path("piece_bpe_32k.model"))
    lp = p.first_weights()[None]
    at = {n: lp[0, i] for i, n in enumerate(p.names)}
    words = [b"the", b"thinking", b"x", "été".encode(), b"abc" * 30, b"q" * 100]
    data = np.frombuffer(b" ".join(words), np.uint8)
    start = np.cumsum([0] + [len(w) + 1 for w in words])[:-1]
    end = start + np.array([len(w) for w in words])
    z, e = lattice.lattice(data, start, end, p, lp, np.ones(len(words)))
    for w, got in zip(words, z[0], strict=True):
        x = b" " + w
        a = [0.0] + [-math.inf] * len(x)
        for j in range(1, len(x) + 1):
            for i in range(j):
                if x[i:j] in at:
                    a[j] = np.logaddexp(a[j], a[i] + at[x[i:j]])
        assert got == pytest.approx(a[-1] + lp[0, -1])
    # every byte lies in one piece: expected lengths add up
    assert (e * np.array([len(n) for n in p.names])).sum() == pytest.approx(sum(len(w) + 1 for w in words))


@pytest.mark.parametrize("head", [10, 1 << 20])
def test_scores(documents, head):
    got = lattice.score_documents(documents, tokenizer_path("piece_bpe_32k.model"), head=head).collect()
    rows = [(r.doc_id, [*WORD.findall(lower(r.text or "")), None]) for r in documents.collect()]
    train = lambda d: zlib.crc32(str(d).encode()) % 5 != 1
    c = Counter(w for d, ws in rows if train(d) for w in ws)
    N, V = sum(c.values()), len(c)
    want = {d: (not train(d), len(ws), sum(c[w] > 0 for w in ws), sum(math.log10((c[w] + 0.5) / (N + 0.5 * (V + 1))) for w in ws)) for d, ws in rows}
    assert len(got) == len(rows)
    for r in got:
        h, n, k, b = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, n, k, N) and r.base_score == pytest.approx(b)
        assert r.score < 0 and math.isfinite(r.score)
    assert lattice.score_documents(empty(documents), tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_score_does_not_depend_on_the_head(documents):
    few, all_ = ({(r.doc_id, r.n_tokens): r.score for r in lattice.score_documents(documents, tokenizer_path("piece_bpe_32k.model"), head=head).collect()} for head in (10, 1 << 20))
    assert len(few) == documents.select("doc_id").distinct().count() and few == pytest.approx(all_, rel=1e-9)


def test_score_depends_on_training_rows_alone(documents):
    path = tokenizer_path("piece_bpe_32k.model")
    held = lattice.fold(F.col("doc_id")) == 1
    scored = lambda d, **o: {(r.doc_id, r.n_tokens): r.score for r in lattice.score_documents(d, path, **o).collect()}
    want = scored(documents)
    other = documents.withColumn("lang", F.when(held, F.concat(F.lit("x"), F.col("doc_id"))).otherwise(F.col("lang")))
    assert scored(other) == pytest.approx(want, rel=1e-9)
    assert scored(documents.repartition(7)) == pytest.approx(want, rel=1e-9)
    nulls = documents.withColumn("doc_id", F.lit(None).cast("bigint"))
    assert all(r.score < 0 and not r.held_out for r in lattice.score_documents(nulls, path).collect())


def test_score_of_existing_scores_alone(documents):
    """Without rounds and whole words a document's probability is the product of its words' lattices, by brute force."""
    p = lattice.Pieces.load(tokenizer_path("piece_bpe_32k.model"))
    lp = p.first_weights()
    at = {n: lp[i] for i, n in enumerate(p.names)}

    def spelled(w):
        x = b" " + w.encode()
        a = [0.0] + [-math.inf] * len(x)
        for j in range(1, len(x) + 1):
            for i in range(j):
                if x[i:j] in at:
                    a[j] = np.logaddexp(a[j], a[i] + at[x[i:j]])
        return (a[-1] + lp[-1]) / math.log(10)

    rows = [(1, "the cat sat"), (2, "The naïve dog"), (3, ""), (4, None), (11, "cat")]
    docs = documents.sparkSession.createDataFrame(rows, "doc_id bigint, text string")
    train = [t or "" for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    n, ends = sum(len(WORD.findall(t)) for t in train), len(train)
    for r in lattice.score_documents(docs, tokenizer_path("piece_bpe_32k.model"), rounds=0, words=False).collect():
        words = WORD.findall(lower(dict(rows)[r.doc_id] or ""))
        want = sum(spelled(w) + math.log10(n / (n + ends)) for w in words) + math.log10(ends / (n + ends))
        assert r.score == pytest.approx(want, rel=1e-9)


def test_piece_weights_do_not_depend_on_the_layout(documents):
    p = lattice.Pieces.load(tokenizer_path("piece_bpe_32k.model"))
    one, many = (lattice.train(documents.repartition(k), p)[2] for k in (1, 7))
    assert np.allclose(one, many, rtol=1e-9)


# 6 near duplicates
def groups(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t or ""))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("cap", [2, 32])
def test_near_duplicates(documents, cap):
    want = groups([(r.doc_id, r.text) for r in documents.collect()])
    got = minhash.near_duplicates(documents, cap=cap).collect()
    assert len(got) == documents.count()
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert minhash.near_duplicates(empty(documents), cap=cap).count() == 0


def test_a_large_group_of_near_copies(spark):
    """A chain of edits: neighbours are similar, far ones aren't; one hot group that leaders alone don't join."""
    words = [f"v{k}" for k in range(120)]
    rows = []
    for k in range(90):
        rows.append((1000 - k, " ".join(f"e{j}" if j < k else w for j, w in enumerate(words))))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = groups(rows)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, cap=4).collect()}
    assert got == {d: c for d, (_, c) in want.items()} and len(set(got.values())) == 1


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_components(spark, one_task):
    rng = np.random.default_rng(0)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))]
    root = list(range(300))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in e:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.comp for r in simjoin.components(spark.createDataFrame(e, "u bigint, v bigint"), one_task=one_task).collect()}
    assert all(got.get(i, i) == find(i) for i in range(300))


# 7 quality
def base_counts(t):
    t = t or ""
    w, seen, dup = WORD.findall(t), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def test_quality_counts(spark, documents):
    more = spark.createDataFrame([(300, "a\n\na\n\nb"), (301, "x y " * 40), (302, "é ü\té ü\n" * 3), (303, "a b c d e f g h\n" * 2), (304, "# | a\n# | a")], "doc_id bigint, text string")
    df = documents.select("doc_id", "text").unionByName(more)
    want = {r.doc_id: base_counts(r.text) for r in df.collect()}
    got = quality.measure(df).collect()
    assert len(got) == df.count()
    for r in got:
        assert tuple(r[c] for c in quality.COUNTS) == want[r.doc_id], r.doc_id


def test_quality_catches_junk(spark):
    rng = np.random.default_rng(4)
    vocab = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(400)]
    good = [" ".join(rng.choice(vocab, 60)) + "." for _ in range(600)]
    bad = [" ".join(w.upper() + "!!" for w in rng.choice(vocab, 60)) for _ in range(30)] + [" | ".join(rng.choice(vocab, 60)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k < 600), 0) for k in range(0, 660, 2)] + [(0, 1, 0)], "doc_id bigint, quality int, toxic int")
    m = quality.measure(docs)
    rules = quality.fit(m, labels)
    kept = {r.doc_id: r.kept for r in quality.judge(m, rules).collect()}
    assert np.mean([kept[k] for k in range(600)]) > 0.97 and np.mean([kept[k] for k in range(600, 660)]) < 0.05
    assert {r.doc_id for r in quality.filter_documents(docs, rules).collect()} == {k for k, v in kept.items() if v}
    for some in (labels.filter("quality = 1"), empty(labels)):
        assert quality.judge(m, quality.fit(m, some)).count() == 660
    assert quality.judge(quality.measure(empty(docs)), quality.fit(quality.measure(empty(docs)), labels)).count() == 0


# 8 WARC
def test_warc(spark, tmp_path):
    rows = [(k, f"http://x/{k} é\r\n", f"<p>{k % 7}</p>" * (k % 5)) for k in range(60)] + [(60, None, None), (61, "", ""), (None, "u", "zz"), (62, "u", "zz"), (63, "u", "b" * 700_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS first", "2 AS data")
    b = warc.write_bundles(pages, frame_bytes=2_000, bundle_bytes=20_000)
    got = warc.read_bundles(b).collect()
    first = {}
    for i, _, h in rows:
        h = h or ""
        if i is not None:
            first[h] = min(i, first.get(h, i))
    assert len(got) == len(rows)
    html = {i: (h or "").encode() for i, _, h in rows}
    for r in got:
        x = html[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(x), base64.b32encode(hashlib.sha1(x).digest()).decode())
        f = first[x.decode()]
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == f else ("revisit", f))
    places = {r.page_id: r for r in warc.page_index(b).collect()}
    data = {r.bundle: bytes(r.data) for r in b.collect()}
    for k in (3, 63):
        p = places[k]
        assert warc.fetch(data[p.bundle], p.frame, p.offset, p.length)[2] == html[k]
    assert len(data) > 1 and len(warc.seek_table(next(iter(data.values())))) > 1
    import zstandard

    one = next(iter(data.values()))  # the footer is a skippable frame: a plain reader sees the records only
    assert zstandard.ZstdDecompressor().stream_reader(one, read_across_frames=True).read().startswith(b"WARC/1.1")
    warc.export(b, str(tmp_path / "out"))
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {f"{k}.warc.zst": v for k, v in data.items()}
    small = warc.read_bundles(warc.write_bundles(pages, min_bytes=5)).filter("payload_bytes < 5 and record_type = 'revisit'")
    assert small.count() == 0 and warc.write_bundles(empty(pages)).count() == 0


# 9 nearest neighbours
def nearest_of(rows, every=50, k=5):
    """Brute force over scaled vectors: {query: [(-score, id), ...]}, an id counts once, by its nearest vector of the query's length."""
    ok = defaultdict(set)
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v):
            ok[i].add(tuple(float(x) for x in v))
    unit = {i: [np.array(v) / np.abs(v).max() for v in sorted(vs, key=lambda v: (len(v), v))] for i, vs in ok.items()}
    unit = {i: [v / np.linalg.norm(v) for v in vs] for i, vs in unit.items()}
    out = {}
    for q in unit:
        if q % every == 0:
            x = unit[q][0]
            near = {i: max((float(x @ v) for v in vs if len(v) == len(x)), default=None) for i, vs in unit.items() if i != q}
            out[q] = sorted((-s, i) for i, s in near.items() if s is not None)[:k]
    return out


def answers(df, **options):
    got = defaultdict(list)
    for r in ann.nearest(df, **options).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    return got


def recall(got, want):
    assert set(got) == {q for q in want if want[q]}
    for q, found in got.items():
        assert found == sorted(found) and len(found) == len(want[q]) and q not in {v for _, v in found}
    return sum(len({v for _, v in found} & {v for _, v in want[q]}) for q, found in got.items()) / sum(map(len, got.values()))


@pytest.mark.parametrize("options", [{"few": 10, "shard_rows": 700, "rerank": 200, "size": 64, "books": 8}, {}])
def test_nearest(spark, options):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    rows = [(k, x[k].tolist()) for k in range(3000)] + [(10_000 + k, x[50].tolist()) for k in range(300)]  # a large group of copies
    rows += [(20_000, None), (20_001, [0.0] * 16), (20_050, [float("nan")] * 16), (20_052, [1.0] * 15 + [None]), (20_100, [float("inf")] + [1.0] * 15), (7, x[7].tolist())]
    rows += [(30_000 + k, rng.normal(size=3).tolist()) for k in range(120)] + [(40_000, [1.0, 2.0]), (None, x[3].tolist())]  # other lengths
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS shard", "2 AS score")
    want, got = nearest_of([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]), answers(df, **options)
    assert recall(got, want) >= (0.9 if options else 1)
    score = {q: dict((v, s) for s, v in near) for q, near in want.items()}
    assert all(s == pytest.approx(score[q][v], abs=1e-12) for q, found in got.items() for s, v in found if v in score[q])
    assert [v for _, v in got[50]] == [10_000, 10_001, 10_002, 10_003, 10_004]


def test_nearest_of_repeated_rows_and_extreme_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 8))
    rows = [(k, x[k].tolist()) for k in range(400)] + [(7, x[50].tolist())] * 20 + [(1000, x[50].tolist()), (1001, x[50].tolist())]
    rows += [(2000, (x[100] * 1e200).tolist()), (2001, (x[100] * 1e-200).tolist()), (2002, (x[100] * 1e-310).tolist()), (150, x[3].tolist()), (150, x[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for options in ({}, {"few": 10, "shard_rows": 150, "rerank": 150, "size": 64, "books": 8}):
        got = answers(df, **options)
        assert {7, 1000, 1001} <= {v for _, v in got[50]} and len({v for _, v in got[50]}) == 5
        assert {2000, 2001, 2002} <= {v for _, v in got[100]} and all(np.isfinite(s) for s, _ in got[100])
        assert recall(got, nearest_of(rows)) >= 0.9
    assert ann.nearest(df.filter("false")).count() == 0
    assert [r.rank for r in ann.nearest(spark.createDataFrame(rows[:3], df.schema)).collect()] == [1, 2]


# 10 line dedup
def later(rows):
    """Removed (doc_id, line) by comparing all lines with a word; every row is a document, in order of id, nulls last."""
    lines = []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        for k, line in enumerate((t or "").split("\n")):
            if x := frozenset(WORD.findall(lower(line))):
                lines.append(((i, k), len(lines), x))
    gone = {n: b for (_, _, x), (b, n, y) in itertools.combinations(lines, 2) if 4 * len(x & y) >= 3 * len(x | y)}
    return sorted(map(str, gone.values()))


def removed(report):
    return sorted(str((r.doc_id, k)) for r in report for k in r.removed)


def random_lines(seed, rows, vocabulary, longest):
    """Texts of lines over few words, many of them near copies of each other."""
    rng = np.random.default_rng(seed)
    base = [rng.choice(vocabulary, rng.integers(1, longest), replace=False) for _ in range(rows)]
    texts = []
    for k in range(rows):
        some = []
        for w in (base[k], base[rng.integers(rows)].copy(), base[0].copy()):
            if rng.random() < 0.6:
                w = w.copy()
                w[rng.integers(len(w))] = rng.integers(vocabulary)
            some.append(" ".join(f"t{x}" for x in w))
        texts.append("\n".join(some))
    return [(k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("options", [{}, {"cap": 2, "dense": 0}, {"cap": 2}, {"limit": 1}, {"limit": 1, "cap": 2, "dense": 0}, {"cap": 2, "dense": 4, "block": 64}])
def test_line_dedup(documents, options):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = linededup.report(documents, **options).collect()
    assert len(got) == len(rows) and removed(got) == later(rows)
    text = dict(rows)
    for r in got:
        lines = (text[r.doc_id] or "").split("\n")
        kept = "\n".join(x for k, x in enumerate(lines) if k not in r.removed)
        assert r.kept_crc32 == zlib.crc32(kept.encode()) and r.n_removed == len(r.removed)
        assert r.n_lines == (0 if text[r.doc_id] is None else len(lines))
    assert linededup.report(empty(documents)).count() == 0


@pytest.mark.parametrize("options", [{}, {"limit": 4}, {"limit": 4, "cap": 2, "dense": 16}, {"limit": 40, "cap": 4, "dense": 8, "block": 64}])
def test_line_dedup_of_frequent_words(spark, monkeypatch, options):
    monkeypatch.setattr(linededup, "SAMPLED", 4)  # so that long lists of a small table are met
    rows = random_lines(5, 250, 60, 14)
    got = linededup.report(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), **options).collect()
    assert removed(got) == later(rows) and len(removed(got)) > 250


def test_line_dedup_keeps_columns(documents):
    out = linededup.dedup_lines(documents)
    assert out.columns == documents.columns and out.dtypes == documents.dtypes
    assert out.filter("text is not null and n_chars <> length(text)").count() == 0


def test_line_dedup_with_a_full_filter(documents, monkeypatch):
    collect = common.Bloom.collect
    full = common.Bloom(np.full(1 << 13, 255, np.uint8))
    monkeypatch.setattr(common.Bloom, "collect", lambda keys, column, **o: full if column == "d1" else collect(keys, column, **o))
    assert removed(linededup.report(documents).collect()) == later([(r.doc_id, r.text) for r in documents.collect()])


def test_line_dedup_of_short_lines(spark):
    lines = ["Home", "home", "a b", "b a a", "a b c", "c b d a", "a b c d e", "--- ---", "---", "no no no no no", "No", "x y", "", " ", "x y z u", "x y z v"]
    rows = [(k, "\n".join(lines[k % 5 :: 3])) for k in range(8)]
    got = linededup.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert removed(got) == later(rows) != []


def test_line_dedup_of_null_repeated_and_text_ids(spark):
    rows = [(None, "alpha beta\ngamma"), (None, "alpha beta"), ("b", "gamma"), ("a", "alpha beta\nnew words here"), ("a", "alpha beta\nnew words here"), ("a", None)]
    got = linededup.report(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert removed(got) == later(rows) and len(got) == len(rows)
    kept = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted(map(str, kept)) == sorted(map(str, spark.createDataFrame([("b", "gamma"), ("a", "alpha beta\nnew words here"), ("a", None)], "doc_id string, text string").collect()))


def test_line_dedup_before_a_last_newline(spark):
    words = [f"term{k}" for k in range(60)]
    rows = [(2 * k + e, " ".join(words[6 * k : 6 * k + 5 + e]) + "\n" * (2 * e)) for k in range(10) for e in (0, 1)]
    got = linededup.report(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(20, "doc_id")).collect()
    assert removed(got) == later(rows) == sorted(str((2 * k + 1, 0)) for k in range(10))


# shared
def test_words_match_the_pattern():
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("ab \t\n\x0b\x1c\x85é☕"), rng.integers(0, 30))) for _ in range(300)] + ["", None, "a"]
    data, off = common.strings(pa.array(texts))
    w = kernels.Words(data, off)
    assert w.count.tolist() == [len(WORD.findall(t or "")) for t in texts]
    words = [x for t in texts for x in WORD.findall(t or "")]
    assert len(set(words)) == len(set(w.hash.tolist()))
    assert len({(x, h) for x, h in zip(words, w.hash.tolist(), strict=True)}) == len(set(words))


def test_bloom_has_no_false_no(spark):
    keys = spark.range(1000).selectExpr("xxhash64(id) AS k")
    b = common.Bloom.collect(keys, "k")
    k = np.array([r.k for r in keys.collect()])
    assert b.has(k).all() and b.has(np.arange(10_000)).mean() < 0.1
    assert not common.Bloom.collect(empty(keys), "k").has(k).any()


def test_work_folder_needs_a_shared_place(spark):
    assert common.work_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
