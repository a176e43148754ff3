"""Packing, conversation repair and clustering against plain Python, and their edge cases."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import exponion, packing, turn_repair
from granary.llm.queries import word_tokenizer

# Packing.


def plain_differencing(lengths, windows):
    """Window sums by multiway differencing over full lists of windows."""
    parts = [(sorted([0] * (windows - 1) + [n], reverse=True), i) for i, n in enumerate(sorted(lengths, reverse=True))]
    made = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-(p[0][0] - p[0][-1]), p[1]))
        (a, _), (b, _), *parts = parts
        both = sorted((x + y for x, y in zip(a, reversed(b))), reverse=True)
        parts.append(([x - both[-1] for x in both], made))
        made += 1
    low = (sum(lengths) - sum(parts[0][0])) // windows
    return sorted(x + low for x in parts[0][0])


@pytest.mark.parametrize("windows", [1, 2, 3, 7, 20, 40])
def test_differencing_equals_the_plain_form(windows):
    random.seed(windows)
    for n in (1, 5, 30, 60):
        lengths = np.array([random.choice([1, 1, 7, random.randint(1, 1000)]) for _ in range(n)])
        found = packing.differenced(lengths, windows)
        assert sorted(np.bincount(found, lengths, windows).astype(int)) == plain_differencing(lengths.tolist(), windows)


def test_windows_rise_only_where_the_capacity_is_passed():
    assert packing.windows_for(np.array([3, 3, 3]), 5).max() + 1 == 3  # the sum allows two
    assert packing.windows_for(np.array([4, 1, 3, 2]), 5).max() + 1 == 2
    lengths = np.random.default_rng(1).integers(1, 1024, 900)
    sums = np.bincount(packing.windows_for(lengths, 4096), lengths)
    assert sums.max() <= 4096 and sums.sum() > 0.98 * 4096 * len(sums)


def test_cuts_cover_all_ids():
    for n in (1, 1023, 1024, 1025, 4095, 4096, 4097, 9000):
        ends = packing.cuts(n, 4096, 1024)
        sizes = np.diff([0, *ends])
        assert ends[-1] == n and (sizes > 0).all() and set(sizes[sizes > 1024]) <= {4096}


@pytest.fixture(scope="module")
def packed(spark):
    texts = ["", None, "Hello,  World's 12 cafés é 世界", "a\x1cb <|endoftext|>x", "word " * 5000, "ΣΣ İstanbul don't!"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(2, texts[2], "y")] * 3 + [(None, "no id", None)]
    rows += [(100 + i, " ".join(random.Random(i).choices(["alpha", "beta", "gamma's", "(delta)", "9"], k=random.Random(i).randint(0, 900))), None) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string").repartition(5)
    pieces = packing.pack(docs, word_tokenizer(), group_windows=4).persist()
    return rows, pieces


def test_packing_keeps_every_id_once(spark, packed):
    from tokenizers import Tokenizer

    rows, pieces = packed
    tokenizer = Tokenizer.from_str(word_tokenizer())
    want = sorted(str((i, tokenizer.encode(t or "", add_special_tokens=False).ids + [2])) for i, t, _ in rows)
    found, documents = pieces.collect(), []
    by_doc = {}
    for p in found:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"] and zlib.crc32(p["ids"]) == p["ids_crc32"]
        by_doc.setdefault((p["doc_id"], p["doc_tokens"]), []).append((p["start"], ids))
    for (i, tokens), parts in by_doc.items():
        parts.sort()
        copies = sum(start == 0 for start, _ in parts)
        joined = list(itertools.chain.from_iterable(ids for _, ids in parts[::copies]))
        assert len(joined) == tokens
        documents += [str((i, joined))] * copies
    assert sorted(documents) == want


def test_packed_sequences_are_full_and_gapless(packed):
    _, pieces = packed
    sequences = {}
    for p in pieces.collect():
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = pieces.agg(F.sum("length")).first()[0]
    assert len(sequences) <= -(-total // 4096) + 4


def test_sequences_are_padded_unless_a_power_of_two(spark):
    rows = [(7, 0, 3, np.array([5, 6, 2], "<u4").tobytes()), (8, 0, 4, np.array([1, 1, 1, 2], "<u4").tobytes()), (7, 3, 2, np.array([9, 2], "<u4").tobytes())]
    pieces = spark.createDataFrame(rows, "sequence_id long, offset long, length long, ids binary")
    found = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.sequences(pieces, capacity=8).collect()}
    assert found == {7: [5, 6, 2, 9, 2, 0, 0, 0], 8: [1, 1, 1, 2]}


def test_packing_of_an_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id string, text string"), word_tokenizer()).count() == 0


def test_word_cache_is_bounded_and_exact(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHED_WORDS", 20)
    words, tokenizer = packing.Words(word_tokenizer()), Tokenizer.from_str(word_tokenizer())
    for i in range(60):
        text = " ".join(f"w{random.Random(i * 31 + j).randint(0, 50)}é." for j in range(random.Random(i).randint(0, 30)))
        assert np.frombuffer(words.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(words.young) <= 80


def test_plain_words_take_the_short_way():
    from tokenizers import Tokenizer

    spec = word_tokenizer()
    words, tokenizer = packing.Words(spec), Tokenizer.from_str(spec)
    assert words.bare is not None
    texts = ["Grüße, ÉCOLE. straße Ñandú,, e\u0301t\u00e9. a. A, ß. ÿÿ", "it's IT'S don't.x x.y ª º µ, ÷ × İi ſs ﬁ.", "\u0130. \u1e9e, ǅ. Σ. ΑΣ, <|startoftext|> <|endoftext|>. \ufeff. \u200b,"]
    for text in texts:
        assert np.frombuffer(words.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    rules = __import__("json").loads(spec)
    rules["normalizer"] = None
    other = __import__("json").dumps(rules)
    assert packing.Words(other).bare is None
    assert np.frombuffer(packing.Words(other).ids(texts[0]), "<u4").tolist() == Tokenizer.from_str(other).encode(texts[0], add_special_tokens=False).ids


def test_words_equal_the_library_on_any_text():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    words, tokenizer = packing.Words(word_tokenizer()), Tokenizer.from_str(word_tokenizer())
    alphabet = st.one_of(st.sampled_from(" .,'ABCabcéÉßÿ\n\t\u0301\u0308\xa0\x85\x1c\u2003\u3000I\u0130<|>"), st.characters(exclude_categories=["Cs"]))

    @settings(max_examples=600, deadline=None)
    @given(st.text(alphabet, max_size=40))
    def same(text):
        assert np.frombuffer(words.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids

    same()


# Conversation repair.


def plain_repair(rows):
    """(cost, audit, roles, texts) over (role, text, forced, short), by trying every edit at every place."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    from functools import cache

    @cache
    def best(i, last, inserts):
        found = []
        if i == len(rows) and last in ("", "a"):
            found.append((0, "", ()))
        if inserts < 3:
            for role in ("user", "assistant"):
                if role[0] in follows[last]:
                    cost, audit, out = best(i, role[0], inserts + 1)
                    found.append((cost + 5, "I" + audit, ((role, ""), *out)))
        if i < len(rows):
            role, text, forced, short = rows[i]
            cost, audit, out = best(i + 1, last, 0)
            found.append((cost + 2, "D" + audit, out))
            if not forced:
                for letter, name, price in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                    if name[:1] and name[0] in follows[last]:
                        cost, audit, out = best(i + 1, name[0], 0)
                        found.append((cost + price + 5 * short, letter + audit, ((name, text), *out)))
        return min(found) if found else (1 << 40, "", ())

    return best(0, "", 0)


def plain_conversation(rows):
    """The contract's columns for one conversation's rows (turn, role, text), damaged already and in order."""
    white, seen, marked, count = " \t\n\x0b\x0c\r", set(), [], dict(blank=0, duplicate=0, truncated=0)
    for _, role, text in rows:
        bare = text.rstrip(white)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            count[fault] += 1
        marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, out = plain_repair(tuple(marked))
    return dict(gaps=gaps, **count, illegal=illegal, cost=cost, audit=audit, repaired_sha256=hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def plain_damage(rows):
    """Each conversation's rows after the damage, in the operator's order."""
    blank = lambda x: " " if x is None else str(x)
    out = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        text, role = blank(text), "user" if kind == 4 else blank(role)
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out.setdefault(conv, []).extend([(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    for made in out.values():
        made.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    return out


def random_turns(n, seed):
    r = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "user", "assistant", None, "tool", ""], ["Yes.", "No", "Why? ", None, " \n", "It is so!\t", "And"]
    rows = [(r.choice([1, 2, 3, 3, 3, 4, None, 5 + r.randint(0, 40)]), r.choice([None, *range(12)]), r.choice(roles), r.choice(texts) if r.random() < 0.4 else f"text {r.randint(0, 9)}.") for _ in range(n)]
    return rows + rows[:3]


@pytest.mark.parametrize("partitions", [1, 3, 17])
def test_repair_equals_trying_every_edit(spark, partitions):
    rows = random_turns(160, partitions)
    table = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "conv_id long, turn long, role string, text string, part string, audit double").repartition(3)
    found = turn_repair.digests(turn_repair.repair(turn_repair.damaged(table), partitions=partitions)).collect()
    want = {conv: plain_conversation(own) for conv, own in plain_damage(rows).items()}
    assert {r["conv_id"]: {k: r[k] for k in want[r["conv_id"]]} for r in found} == want and len(found) == len(want)


def test_one_conversation_over_many_tasks(spark):
    rows = [(9, i % 101, ("user", "assistant", "system")[(i * 7) % 3], f"line {i % 53}." if i % 5 else "open") for i in range(1200)]
    table = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    fixed = turn_repair.repair(turn_repair.damaged(table), partitions=20)
    assert fixed.count() > 5 and fixed.filter("parts = 1").count() == 0
    found = turn_repair.digests(fixed).first().asDict()
    own = plain_damage(rows)[9]
    want = turn_repair.digests(turn_repair.repair(turn_repair.damaged(table.union(table.limit(0))), partitions=1)).first().asDict()
    assert found == want and found["duplicate"] > 100 and len(found["audit"].replace("I", "")) == len(own)


def test_repair_of_other_ids_and_nothing(spark):
    rows = [("b", 0, "user", "Hi."), ("b", 1, "assistant", "Hello."), (None, 0, "assistant", "Alone."), ("gone", 3, "user", "x")]
    table = spark.createDataFrame(rows, "conv_id string, turn short, role string, text string").withColumn("present", F.expr("conv_id is null or conv_id <> 'gone'"))
    found = {r["conv_id"]: r for r in turn_repair.digests(turn_repair.repair(table)).collect()}
    assert found["b"]["audit"] == "KK" and found["b"]["cost"] == 0 and found[None]["audit"] == "D"
    assert found["gone"]["audit"] == "" and found["gone"]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    assert turn_repair.digests(turn_repair.repair(table.limit(0))).count() == 0


def test_bits_price_like_the_whole():
    r = random.Random(5)
    for _ in range(50):
        codes = bytes(r.choice([1, 2, 3, 0, 6, 10, 11, 7]) for _ in range(r.randint(0, 12)))
        cut = r.randint(0, len(codes))
        left, right = turn_repair.transfer(codes[:cut]), turn_repair.transfer(codes[cut:])
        both = [min(left[4 * s + m] + right[4 * m + t] for m in range(4)) for s in range(4) for t in range(4)]
        assert [x if x < 1 << 59 else -1 for x in both] == [x if x < 1 << 59 else -1 for x in turn_repair.transfer(codes)]
        ends = tuple(min(right[4 * s + t] + turn_repair.ENDS[t] for t in range(4)) for s in range(4))
        first, state = turn_repair.walk(codes[:cut], ends, turn_repair.START, False)
        assert first + turn_repair.walk(codes[cut:], turn_repair.ENDS, state, True)[0] == turn_repair.walk(codes, turn_repair.ENDS, turn_repair.START, True)[0]


# Centroid clustering.


def plain_clusters(rows, k, rounds, size=64):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in start]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((far(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            if members := [v for (_, v), c in zip(kept, own) if c == n]:
                centroids[n] = [sum(x) // len(members) for x in zip(*members)]
    return sorted(((str(i), n, d) for i, v in kept for d, n in [nearest(v)]), key=str), centroids


@pytest.mark.parametrize("k,rounds", [(1, 2), (5, 3), (16, 3)])
def test_clusters_equal_plain_rounds(spark, k, rounds):
    r = np.random.default_rng(k)
    middle = r.normal(0, 0.5, (6, 64))
    rows = [(int(i), [float(x) for x in np.round(middle[i % 6] + r.normal(0, 0.15, 64), 1)]) for i in range(300)]
    rows += rows[:20] + [(7, [0.5] * 64)] * 30 + [(None, [0.25] * 64), (900, None), (901, [1.0] * 63), (902, [float("nan")] * 64), (903, [float("inf")] + [0.0] * 63), (904, [None] + [0.0] * 63), (905, [-0.001] * 64)]
    table = spark.createDataFrame([(*row, 3, 4) for row in rows], "vec_id long, embedding array<double>, cluster int, vector int").repartition(4)
    found, centroids = exponion.exponion_clusters(exponion.integer_vectors(table), k=k, rounds=rounds)
    want, plain = plain_clusters(rows, k, rounds)
    assert sorted(((str(x["vec_id"]), x["cluster"], x["distance"]) for x in found.collect()), key=str) == want
    assert centroids.tolist() == plain
    whole = exponion.with_inertia(found, centroids).collect()
    assert {x["inertia"] for x in whole} == {sum(d for _, _, d in want)} and len(whole) == len(want)


def test_search_scans_few_and_misses_none():
    r = np.random.default_rng(3)
    middle = r.integers(-200, 200, (40, 8))
    rows = (middle[r.integers(0, 40, 3000)] + r.integers(-8, 9, (3000, 8))).astype(np.int32)
    centroids = rows[:40].astype(np.int64)
    cluster, upper, lower, taken = np.full(3000, -1, np.int64), np.zeros(3000), np.full(3000, np.inf), []
    for _ in range(5):
        taken.append(exponion.Search(centroids).settle(rows, cluster, upper, lower))
        assert (cluster == exponion.squared(rows, centroids).argmin(1)).all()
        after = np.array([rows[cluster == n].sum(0) // max(1, (cluster == n).sum()) if (cluster == n).any() else centroids[n] for n in range(40)])
        exponion.moved((cluster, upper, lower), np.sqrt(((after - centroids) ** 2).sum(1).astype(float)))
        centroids = after
    assert taken[0] < 41 * 3000 and sum(taken[1:]) < 0.5 * 4 * taken[0]


def test_ties_go_to_the_smaller_number():
    centroids = np.array([[4, 0], [-4, 0], [0, 4], [0, -4], [4, 0]])
    rows = np.zeros((3, 2), np.int32)
    cluster, upper, lower = np.array([3, 4, -1]), np.full(3, 4.0), np.full(3, 4.0)
    exponion.Search(centroids).settle(rows, cluster, upper, lower)
    assert cluster.tolist() == [0, 0, 0]


def test_large_components_and_no_vectors(spark):
    table = spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64), (3, [3e5] * 64)], "vec_id long, embedding array<double>")
    found = exponion.exponion_clusters(exponion.integer_vectors(table), k=2)[0].collect()
    assert len(found) == 3 and min(r["distance"] for r in found) >= 0
    none, centroids = exponion.exponion_clusters(exponion.integer_vectors(table.limit(0)))
    assert exponion.with_inertia(none, centroids).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and none.count() == 0
