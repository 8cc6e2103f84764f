"""Exact, substring, line, embedding and SimHash dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from edgeloom.llm.common import chunked, runs_of
from edgeloom.llm.exact_dedup import PerfectHash, exact_dedup
from edgeloom.llm.line_dedup import edit_distance, index_keys, line_dedup, probe_keys
from edgeloom.llm.metric_join import cells_of, metric_dedup, unit
from edgeloom.llm.simhash import balls, fingerprint, first_shingles, keep_one, long_fingerprint, parities, similar_dedup, simhash_dedup
from edgeloom.llm.substring_dedup import rolled, sliding_min, substring_dedup

DOCS = "doc_id bigint, text string, lang string, part string, digest string, keep_id int, chunk int, fp string, winner int, least int, node int"


def frame(spark, pairs):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", "p", "d", 1, 2, "f", 3, 4, 5) for i, t in pairs], DOCS).repartition(3)


def words_text(rng, n, kinds=60):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def components(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


# Exact


def test_perfect_hash_is_minimal_and_byte_checked():
    rng = np.random.default_rng(1)
    words = np.unique(rng.integers(0, 1 << 63, (5000, 4), dtype=np.uint64), axis=0)
    mph = PerfectHash.build(words)
    slots = mph.slots(words)
    assert sorted(slots.tolist()) == list(range(len(words)))
    stored = np.empty_like(words)
    stored[slots] = words
    other = rng.integers(0, 1 << 63, (5000, 4), dtype=np.uint64)
    at = mph.slots(other)
    assert not ((at >= 0) & (stored[at] == other).all(axis=1)).any()
    assert len(PerfectHash.build(words[:0]).slots(words[:3])) == 3


def test_exact_dedup(spark, rows):
    rng = random.Random(2)
    texts = [None, "", " a  b", " a b", "a\tb", "a b", "a\x0bb", "x" * 300_000, "é  ü", " a"]
    pairs = [(i, rng.choice(texts)) for i in range(200)] + [(7, "a b"), (None, "only null"), (None, "a b")]
    pairs += [(500 + i, "hot copy") for i in range(300)]
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in pairs]
    first, size = {}, {}
    for (i, _), t in zip(pairs, norm):
        size[t] = size.get(t, 0) + 1
        if i is not None:
            first[t] = min(i, first.get(t, i))
    want = sorted(((i, first.get(t), size[t], i == first.get(t), hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(pairs, norm)), key=repr)
    assert rows(exact_dedup(frame(spark, pairs))) == want
    assert rows(exact_dedup(frame(spark, pairs), history_below=40, digests_each=2)) == want
    assert rows(exact_dedup(frame(spark, pairs[:0]))) == []


# Substring


def brute_substring(pairs, n):
    key = lambda i: (i is None, i)
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in pairs]
    for i, w in split:
        for s in range(len(w) - n + 1):
            x = tuple(w[s : s + n])
            first[x] = min(first.get(x, (key(i), s)), (key(i), s))
    out = []
    for i, w in split:
        gone = set()
        for s in range(len(w) - n + 1):
            if first[tuple(w[s : s + n])] < (key(i), s):
                gone |= set(range(s, s + n))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_rolling_and_sliding():
    x = np.random.default_rng(3).integers(0, 1 << 63, 100, dtype=np.uint64)
    for n in (1, 2, 3, 10, 20, 64):
        m = 0x9E3779B97F4A7C15
        want = [sum(int(x[i + k]) * pow(m, n - 1 - k, 1 << 64) for k in range(n)) % (1 << 64) for i in range(101 - n)]
        assert rolled(x, n, m).tolist() == want
        assert sliding_min(x, n).tolist() == [int(x[i : i + n].min()) for i in range(101 - n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, rows, seed):
    rng = random.Random(seed)
    passage = words_text(rng, 60, 10**6)
    pairs = [(i, words_text(rng, rng.randrange(50), 10**6) + " " + passage + "\n" + words_text(rng, rng.randrange(40), 10**6)) for i in range(40)]
    pairs += [(100 + i, rng.choice([None, "", "a " * 90, "a b " * 40, "one", passage, " x " * 25])) for i in range(40)]
    pairs += [(3, pairs[3][1]), (None, passage), (None, passage + " end"), (400, words_text(rng, 30_000, 10**6))]
    rng.shuffle(pairs)
    want = brute_substring(pairs, 20)
    assert rows(substring_dedup(frame(spark, pairs))) == want
    assert rows(substring_dedup(frame(spark, pairs), chunk_bytes=20_000)) == want
    assert rows(substring_dedup(frame(spark, pairs[:0]))) == []


def test_substring_texts_and_small_windows(spark, rows):
    pairs = [(1, "a b c d e f"), (2, "x b c d y"), (3, "b c d")]
    got = rows(substring_dedup(frame(spark, pairs), window=3, anchor=2, texts=True).select("doc_id", "kept_text"))
    assert got == [(1, "a b c d e f"), (2, "x y"), (3, "")]


# Lines


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def edited(rng, line, edits):
    b = bytearray(line)
    for _ in range(edits):
        at, kind = rng.randrange(len(b) + 1), rng.randrange(3)
        if kind == 0 or at == len(b):
            b.insert(at, rng.choice(b"abc"))
        elif kind == 1:
            del b[at]
        else:
            b[at] = rng.choice(b"abc")
    return bytes(b)


def test_edit_distance_and_segments():
    rng = random.Random(4)
    for _ in range(4000):
        a = bytes(rng.choice(b"abc") for _ in range(rng.randrange(15)))
        b = edited(rng, a, rng.randrange(5))
        for most in (1, 2, 3):
            d = levenshtein(a, b)
            assert edit_distance(a, b, most) == min(d, most + 1)
            long, short = (a, b) if len(a) >= len(b) else (b, a)
            if 0 < d <= most < len(short):
                assert set(index_keys(short, most)) & {*probe_keys(long, most, most + 1), *index_keys(long, most)}


@pytest.mark.parametrize("edits", [1, 2])
def test_line_dedup(spark, rows, edits):
    rng = random.Random(5)
    base = [bytes(rng.choice(b"abcdefgh ") for _ in range(rng.randrange(12, 40))) for _ in range(30)]
    line = lambda: edited(rng, rng.choice(base), rng.randrange(4)).decode()
    pairs = [(i, "\n".join(line() for _ in range(rng.randrange(1, 8))) + rng.choice(["", "\n", "\nshort", "\nshore", "\n \t", "\nabcdefghijk", "\nabcdefghijl"])) for i in range(60)]
    pairs += [(70, None), (71, ""), (72, "\n\n"), (73, "z" * 50_000), (74, "z" * 49_999 + "\n" + "common line of text"), (None, "common line of text")]
    pairs += [(80 + i, "common line of text\n" + line()) for i in range(40)]
    rng.shuffle(pairs)
    places = sorted(((i is None, i if i is not None else 0, k), x.encode()) for i, t in pairs for k, x in enumerate((t or "").split("\n")) if t and x.strip())
    distinct = {}
    for place, x in places:
        distinct.setdefault(x, place)
    lines = list(distinct)
    links = [(a, b) for a in range(len(lines)) for b in range(a) if min(len(lines[a]), len(lines[b])) >= 12 and abs(len(lines[a]) - len(lines[b])) <= edits and (len(lines[a]) < 100 or lines[a][: len(lines[b])] == lines[b]) and (len(lines[a]) >= 100 or levenshtein(lines[a], lines[b]) <= edits)]
    links += [(b, a) for a in range(len(lines)) for b in range(a) if len(lines[a]) >= 100 and lines[b][: len(lines[a])] == lines[a] and len(lines[b]) - len(lines[a]) <= edits]
    group = components(range(len(lines)), links)
    winner = {}
    for k, x in enumerate(lines):
        winner[group[k]] = min(winner.get(group[k], distinct[x]), distinct[x])
    stays = set(winner.values())
    want = []
    for i, t in pairs:
        split = t.split("\n") if t else []
        kept = [x for k, x in enumerate(split) if not x.strip() or (i is None, i if i is not None else 0, k) in stays]
        want.append((i, len(split), len(split) - len(kept), "\n".join(kept)))
    got = line_dedup(frame(spark, pairs), edits=edits, chunk_bytes=2000, texts=True).select("doc_id", "n_lines", "n_removed", "kept_text")
    assert rows(got) == sorted(want, key=repr)
    assert rows(line_dedup(frame(spark, pairs[:0]))) == []
    with pytest.raises(ValueError):
        line_dedup(frame(spark, pairs), edits=5, min_bytes=5)


def test_one_of_equal_lines_stays_whatever_their_ids(spark, rows):
    pairs = [(None, f"the common line of all texts\nline {k} of its own and nobody else's") for k in range(40)]
    pairs += [(5, "alpha beta gamma delta\nepsilon"), (5, "epsilon\nalpha beta gamma delta"), (5, "alpha beta gamma delta\nepsilon")]
    pairs += [(9, "wholly repeated row")] * 6
    first = rows(line_dedup(frame(spark, pairs), chunk_bytes=60, texts=True).select("doc_id", "kept_text"))
    kept = [x for _, t in first for x in t.split("\n") if x]
    assert sorted(kept) == sorted({x for _, t in pairs for x in t.split("\n")}) or len(kept) == len(set(kept))
    assert {"the common line of all texts", "alpha beta gamma delta", "epsilon", "wholly repeated row"} <= set(kept)
    again = rows(line_dedup(frame(spark, pairs), chunk_bytes=60, texts=True).select("doc_id", "kept_text"))
    assert again == first


def test_runs_of():
    rng = np.random.default_rng(3)
    for n in (0, 1, 500):
        keys = rng.integers(0, 20, n)
        got = runs_of(keys)
        assert [k for k, _ in got] == sorted(set(keys.tolist())) and all((keys[own] == k).all() and (np.diff(own) > 0).all() for k, own in got)
        assert sum(len(own) for _, own in got) == n


# Embeddings


@pytest.mark.parametrize("cell_rows", [4096, 12])
def test_metric_dedup(spark, rows, cell_rows):
    rng = np.random.default_rng(6)
    vectors, labels = [], []
    for k in range(150):
        x = rng.standard_normal(8)
        for _ in range(rng.integers(1, 4)):
            vectors.append((x + rng.standard_normal(8) * 0.06).tolist())
            labels.append(int(k % 3))
    vectors += [vectors[0]] * 5 + [None, [0.0] * 8, [float("nan")] * 8, [1.0, None] * 4, [float("inf")] * 8, [1.0, 2.0], [2.0, 4.0], []]
    labels += [labels[0]] * 5 + [0] * 8
    vectors += [vectors[0], vectors[0]]
    labels += [None, None]
    ids = list(range(len(vectors)))
    ok = lambda v: v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v)
    links = []
    for a in ids:
        for b in ids[:a]:
            u, v = vectors[a], vectors[b]
            if labels[a] is not None and labels[a] == labels[b] and ok(u) and ok(v) and len(u) == len(v):
                u, v = np.array(np.float32(u), float), np.array(np.float32(v), float)
                if u @ v / (np.sqrt(u @ u) * np.sqrt(v @ v)) >= 0.98:
                    links.append((a, b))
    group = components(ids, links)
    number = {i: 0 for i in ids}
    for a, b in links:
        number[a] += 1
        number[b] += 1
    table = spark.createDataFrame([(i, v, x, 0, 0) for i, v, x in zip(ids, vectors, labels)], "vec_id bigint, embedding array<float>, label int, node int, links int").repartition(3)
    assert rows(metric_dedup(table, cell_rows=cell_rows)) == sorted(((i, number[i], group[i], group[i] == i) for i in ids), key=repr)
    assert rows(metric_dedup(table.limit(0))) == []


def test_vectors_without_an_id_of_their_own(spark, rows):
    def run(data):
        table = spark.createDataFrame([(i, v, "a") for i, v in data], "vec_id bigint, embedding array<double>, label string")
        return rows(metric_dedup(table).select("vec_id", "n_links", "component_id"))

    assert run([(7, [1.0, 0.0]), (7, [0.0, 1.0]), (8, [1.0, 0.01])]) == [(7, 0, 7), (7, 1, 7), (8, 1, 7)]
    assert run([(7, [1.0, 0.0]), (7, [1.0, 0.001])]) == [(7, 1, 7), (7, 1, 7)]
    assert run([(None, [1.0, 0.0]), (-1, [0.0, 1.0])]) == sorted([(None, 0, None), (-1, 0, -1)], key=repr)
    assert run([(None, [1.0, 0.0]), (None, [1.0, 0.0]), (-5, [1.0, 0.0])]) == sorted([(None, 2, -5), (None, 2, -5), (-5, 2, -5)], key=repr)


def test_cells_hold_all_partners():
    rng = np.random.default_rng(7)
    x = unit(rng.standard_normal((400, 3)).tolist())
    home, copied = cells_of(x, x[:9], 0.3)
    assert copied.mean() < 0.6
    d = np.sqrt(np.maximum(2 - 2 * x @ x.T, 0))
    for a, b in zip(*np.nonzero(d <= 0.3)):
        assert home[a] == home[b] or copied[a, home[b]] and copied[b, home[a]]


# SimHash


def brute_fingerprint(text, width):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    rng = random.Random(8)
    for text in [None, "", " \t", "One", "One two", "ÀB c d e", *(words_text(rng, rng.randrange(1, 60)) for _ in range(50))]:
        for width in (1, 3, 5):
            assert fingerprint(None if text is None else text.encode(), width) == brute_fingerprint(text, width)


def test_balls_cover():
    rng = random.Random(9)
    for segments, most in ((2, 3), (4, 3), (3, 7)):
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), rng.randrange(most + 1)):
                b ^= 1 << bit
            assert any((a >> low & mask) ^ (b >> low & mask) in flips for low, mask, flips in balls(segments, most))


def test_simhash_dedup(spark, rows):
    rng = random.Random(10)
    pairs = []
    for k in range(40):
        words = words_text(rng, 400, 10**6).split()
        for _ in range(4):
            own = list(words)
            own[rng.randrange(400)] = "changed"
            pairs.append((len(pairs), " ".join(own)))
    pairs += [(1000, None), (1001, ""), (1002, "\n"), (1003, "Copy A"), (1004, "copy a"), (1003, "Copy A"), (None, "copy  a"), (1005, "x" * 200_000)]
    fps = [brute_fingerprint(t, 3) for _, t in pairs]
    at = list(range(len(pairs)))
    group = components(at, [(a, b) for a in at for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 3])
    least = {}
    for k, (i, _) in enumerate(pairs):
        if i is not None:
            least[group[k]] = min(i, least.get(group[k], i))
    want = sorted(((i, f"{fps[k]:016x}", least.get(group[k]), i == least.get(group[k])) for k, (i, _) in enumerate(pairs)), key=repr)
    assert len(least) < len(set(fps))
    assert rows(simhash_dedup(frame(spark, pairs))) == want
    assert rows(simhash_dedup(frame(spark, pairs), segments=4)) == want
    assert rows(simhash_dedup(frame(spark, pairs[:0]))) == []


def test_similar_dedup_and_keep_one(spark, rows):
    rng = random.Random(11)
    pairs, original = [], {}
    for k in range(30):
        words = words_text(rng, 300, 10**6).split()
        for _ in range(5):
            own = list(words)
            for at in rng.sample(range(300), 3):
                own[at] = f"new{rng.randrange(10**6)}"
            original[len(pairs)] = k
            pairs.append((len(pairs), " ".join(own)))
    got = rows(similar_dedup(frame(spark, pairs)).select("doc_id", "component_id"))
    assert [c for _, c in got] == [i - i % 5 for i, _ in got]
    more = [*pairs, (0, pairs[0][1]), (0, pairs[0][1]), (None, None), (900, ""), (None, "only here"), (None, "only here"), (None, "here too"), (None, pairs[8][1])]
    kept = keep_one(frame(spark, more))
    assert kept.columns == frame(spark, more).columns
    assert rows(kept.select("doc_id", "text")) == sorted([*(pairs[i] for i in range(0, 150, 5)), (900, ""), (None, "only here"), (None, "here too")], key=repr)
    assert keep_one(frame(spark, more[:0])).count() == 0


def test_similar_dedup_checks_the_similarity(spark, rows, monkeypatch):
    rng = random.Random(17)
    pairs = []
    for _ in range(40):
        words = words_text(rng, 300, 10**6).split()
        for changed in (0, 4, 11, 15):  # similarities to the first of about 0.88, 0.69 and 0.6
            own = list(words)
            for at in range(changed):
                own[20 * at + 5] = f"new{rng.randrange(10**6)}"
            pairs.append((len(pairs), " ".join(own)))
    pairs += [(len(pairs), pairs[0][1].upper()), (900, ""), (901, None)]
    split = [(t or "").lower().split() for _, t in pairs]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in split]
    prints = [long_fingerprint((t or "").encode(), 5, 3, 0)[0] for _, t in pairs]
    close = lambda i, j: sum((a ^ b).bit_count() for a, b in zip(prints[i], prints[j])) <= 40
    alike = lambda i, j: sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    near = [(i, j) for i in range(len(pairs)) for j in range(i) if close(i, j)]
    group = components(range(len(pairs)), [(i, j) for i, j in near if alike(i, j)])
    assert any(not alike(i, j) for i, j in near)
    want = sorted(((i, min(pairs[j][0] for j in range(len(pairs)) if group[j] == group[k])) for k, (i, _) in enumerate(pairs)), key=repr)
    assert rows(similar_dedup(frame(spark, pairs)).select("doc_id", "component_id")) == want
    monkeypatch.setattr("edgeloom.llm.simhash.SIDE", 2)  # several sides to a component
    assert rows(similar_dedup(frame(spark, pairs)).select("doc_id", "component_id")) == want
    assert [i for i, _ in rows(keep_one(frame(spark, pairs)).select("doc_id", "text"))] == sorted({c for _, c in want}, key=lambda c: repr((c, "")))


def similar_pairs(sets, least):
    """All pairs of a similarity of ``least`` or more, by brute force over an index of shingles."""
    at = {}
    for k, s in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(k)
    shared = Counter((i, j) for ks in at.values() for n, j in enumerate(ks) for i in ks[:n])
    return {p for p, n in shared.items() if n >= least * (len(sets[p[0]]) + len(sets[p[1]]) - n)}


def test_recall_of_near_copies(spark, rows):
    rng = random.Random(23)
    texts = []
    for _ in range(150):
        words = words_text(rng, rng.randrange(60, 400), 10**6).split()
        own = list(words)
        n = len(words) - 4
        for at in rng.sample(range(len(words)), max(1, round(0.105 * n / 5))):  # a similarity just over 0.8, mostly
            own[at] = f"new{rng.randrange(10**6)}"
        texts += [" ".join(words), " ".join(own)]
    split = [t.split() for t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in split]
    wanted = similar_pairs(sets, 0.8)
    component = dict(rows(similar_dedup(frame(spark, list(enumerate(texts)))).select("doc_id", "component_id")))
    found = {p for p in wanted if component[p[0]] == component[p[1]]}
    assert len(wanted) > 80 and len(found) >= 0.95 * len(wanted)
    assert all(component[i] == i or (component[i], i) in wanted for i in component)


def test_no_similar_pair_is_left_out(spark, rows, monkeypatch):
    rng = random.Random(29)
    texts = []
    for _ in range(60):  # a phrase many times over turns the bits of a fingerprint, but adds few shingles
        words = words_text(rng, rng.randrange(90, 200), 10**6).split()
        texts += [" ".join(words), " ".join([*words, *words[20:30] * 40])]
    for _ in range(200):
        words = words_text(rng, rng.randrange(30, 200), 10**6).split()
        own, n = list(words), len(words) - 4
        for at in rng.sample(range(len(words)), max(1, round(0.105 * n / 5))):
            own[at] = f"new{rng.randrange(10**6)}"
        texts += [" ".join(words), " ".join(own)]
    passage = words_text(rng, 60, 10**6)  # its shingles are frequent ones
    texts += [f"{words_text(rng, 8, 10**6)} {passage} {words_text(rng, k % 5, 10**6)}" for k in range(40)]
    prints = [long_fingerprint(t.encode(), 5, 3, 0)[0] for t in texts]
    split = [t.split() for t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in split]
    wanted = similar_pairs(sets, 0.8)
    assert sum(sum((a ^ b).bit_count() for a, b in zip(prints[i], prints[j])) > 40 for i, j in wanted) > 50
    group = components(range(len(texts)), wanted)
    want = sorted(((i, min(j for j in range(len(texts)) if group[j] == group[i])) for i in range(len(texts))), key=repr)
    assert rows(similar_dedup(frame(spark, list(enumerate(texts)))).select("doc_id", "component_id")) == want
    monkeypatch.setattr("edgeloom.llm.simhash.SHINGLES", 64)  # several shards and blocks, short strips
    monkeypatch.setattr("edgeloom.llm.simhash.STORED", 16)
    monkeypatch.setattr("edgeloom.llm.simhash.STRIP_BYTES", 64)
    assert rows(similar_dedup(frame(spark, list(enumerate(texts)))).select("doc_id", "component_id")) == want


def test_first_shingles_meet():
    rng = np.random.default_rng(31)
    for n in [*range(1, 40), 200, 5000]:
        for _ in range(20):
            a = rng.choice(1 << 40, n, replace=False).astype(np.uint64)
            gone = rng.integers(0, n // 5 + 1)
            b = np.concatenate([a[gone:], rng.choice(1 << 40, rng.integers(0, n // 5 + 1), replace=False).astype(np.uint64)])
            a, b = np.unique(a), np.unique(b)
            both = np.intersect1d(a, b)
            if len(both) < 0.8 * len(np.union1d(a, b)):
                continue
            known = np.sort(rng.choice(both, len(both) // 3, replace=False))
            frequent = known, rng.permutation(len(known))
            (x, i), (y, j) = first_shingles(a, frequent, 0.8), first_shingles(b, frequent, 0.8)
            assert np.isin(x, y[:j]).any() if len(b) <= len(a) else np.isin(x[:i], y).any()
            p, q = (np.frombuffer(parities(z), np.uint8) for z in (a, b))
            short = min(len(p), len(q))
            p, q = (np.bitwise_xor.reduce(z.reshape(-1, short), axis=0) for z in (p, q))
            assert np.bitwise_count(p ^ q).sum() <= len(a) + len(b) - 2 * len(both)


def test_names_may_hold_anything(spark, rows):
    odd = spark.createDataFrame([(1, "one text", 5), (2, "one text", 6)], "doc_id bigint, text string, `a.b c` int")
    assert rows(keep_one(odd)) == [(1, "one text", 5)]
    got = line_dedup(odd, texts=True, carry=True)
    assert rows(got.select("doc_id", "kept_text", F.col("doc.`a.b c`"))) == [(1, "one text", 5), (2, "", 6)]


def test_chunks_carry_other_columns(spark):
    dealt, n = chunked(frame(spark, [(1, "abc"), (None, None)]), "doc_id", "text", 2, carry=True)
    assert n == 2 and dealt.columns == ["chunk", "doc_id", "text", "doc"]
    assert dealt.where(F.col("chunk").isNull()).isEmpty()
