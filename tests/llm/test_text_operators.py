"""Each operator on small tables against brute force: nulls, empty and long texts, ties, repeats, empty tables, clashes."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gridregimes.llm import chat_format, decontaminate, exact_dedup, html_extract, near_dedup, packing, quality, sharding, token_files, tokens, toxicity
from gridregimes.llm.common import Scratch

TOK = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, id string, row string, found string, n int, h long"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def make_texts():
    rng = random.Random(3)
    vocabulary = ["the", "of", "Über", "naïve", "中文", "word", "x1", "y_2", "end.", "A", "b!", "été"] + [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 160))) for _ in range(30)]
    texts = [None, "", "  ", "one", "ONE", "one two", "One  two\n", "É", "é", "a" * 3000, "x " * 4000] + base + base[:6] + [b.upper() for b in base[:4]]
    for b in base[:12]:
        w = b.split(" ")
        for _ in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    return texts


TEXTS = make_texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "clash", "clash", "clash", 1, 2) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs):
    groups = defaultdict(list)
    for i, t in enumerate(TEXTS):
        groups[low(t)].append(i)
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        g = groups[low(t)]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(g), len(g), i == max(g))
        assert got[i].text_sha256 == hashlib.sha256(low(t).encode()).hexdigest()
    # a filter of one bitmap marks nearly all rows, and a result that is still whole
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.exact_dedup(docs, max_bits=32768).collect()} == {(i, r.keep_id) for i, r in got.items()}
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(max(g) for g in groups.values())


def test_exact_dedup_repeated_rows_and_null_ids(spark, empty):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "A"), (None, "b")], "doc_id long, text string")
    got = exact_dedup.exact_dedup(rows).collect()
    assert sum(r.kept for r in got) == 2 and len(got) == 4
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(1, 1, 3), (None, 1, 3), (None, None, 1)}
    assert sorted((r.doc_id is None, r.text) for r in exact_dedup.drop_exact_duplicates(rows).collect()) == [(False, "a"), (True, "b")]
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.drop_exact_duplicates(empty).count() == 0


def test_filter_has_no_false_negative(spark):
    hashes = spark.range(3000).select((F.col("id") % 2000).alias("v")).select(F.xxhash64("v").alias("h"), "v")
    bits = exact_dedup.filter_bits(100)
    marked = exact_dedup.mark(hashes, exact_dedup.filter_of(hashes, bits), bits)
    assert marked.where("v < 1000 AND NOT maybe").count() == 0
    bits = exact_dedup.filter_bits(3000)
    assert exact_dedup.mark(hashes, exact_dedup.filter_of(hashes, bits), bits).where("v >= 1000 AND maybe").count() < 100


def test_sharding(docs, empty):
    got = sorted(sharding.shard_by_bytes(docs, 5).collect(), key=lambda r: r.doc_id)
    sizes = [len((t or "").encode()) + 1 for t in TEXTS]
    assert [r.size for r in got] == sizes and [r.text_crc32 for r in got] == [zlib.crc32((t or "").encode()) for t in TEXTS]
    assert [r.shard for r in got] == sorted(r.shard for r in got)  # contiguous in id order
    totals, slots = Counter(), defaultdict(list)
    for r in got:
        totals[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(v == list(range(len(v))) for v in slots.values())
    assert max(abs(v - sum(sizes) / 5) for v in totals.values()) <= max(sizes)
    before = 0
    for r, size in zip(got, sizes):
        assert r.byte_start == before and r.shard == before * 5 // sum(sizes)
        before += size
    assert sharding.shard_by_bytes(empty, 5).count() == 0


def test_sharding_of_one_frequent_id(spark):
    rows = spark.createDataFrame([(7 if i % 3 else i, "t") for i in range(300)] + [(None, None)], "doc_id long, text string")
    got = sharding.shard_by_bytes(rows, 4).collect()
    assert len(got) == 301 and max(Counter(r.shard for r in got).values()) <= 77


def conversation_rows():
    said = ["", None, "</s>[INST] ok [/INST]", "<|turn|>user<|text|>x<|end|>", "\\", "\\\\<s>\\", "a\\<|end|>", "[\\INST]", "<<SYS>>\n<</SYS>>", "line\nline", "é中🎉", "<|im_end|>"]
    roles = ["user", "assistant", "system", None, "assistant", "we<|text|>ird", "\\"]
    return [(c, t, roles[(c + t) % 7], said[(c * 5 + t) % 12], "clash") for c in range(12) for t in range(1 + c % 6)]


def test_chat_round_trip(spark):
    rows = conversation_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, kind string").repartition(3)
    shown = chat_format.render(chat_format.fold_events(chat_format.events_of(df)))
    got = {r.conv_id: r for r in chat_format.read_back(shown).collect()}
    want = defaultdict(list)
    for c, t, role, text, _ in sorted(rows, key=lambda r: r[:2]):
        want[c].append((role or "", text or ""))
    assert got.keys() == want.keys()
    for c, turns in want.items():
        assert [(x.role, x.text) for x in got[c].turns] == turns
        assert got[c].loss_text == "".join(t for r, t in turns if r == "assistant")
    for r in shown.collect():
        assert r.formatted.count("<|turn|>") == r.n_turns == r.formatted.count("<|end|>")
        assert not re.search(r"\[/?INST\]|</?s>|<</?SYS>>|<\|im_end\|>", r.formatted)
        for m in r.loss_mask:
            assert r.formatted[: m.start].endswith("<|text|>") and r.formatted[m.start + m.length :].startswith("<|end|>")


def test_chat_events(spark):
    events = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", ""), (1, 2, 1, "delta", "assistant", "Hel"), (1, 3, 1, "delta", "assistant", "lo"),
        (1, 4, 1, "regenerate", "assistant", None), (1, 5, 1, "delta", "assistant", "Good "), (1, 6, 1, "delta", "assistant", "day"),
        (1, 7, 2, "message", "user", "dropped"), (1, 8, 1, "regenerate", "assistant", None), (1, 9, 1, "delta", "assistant", "Bye"),
        (2, 0, 0, "message", "user", "tpyo"), (2, 1, 1, None, "assistant", "ok"), (2, 2, 0, "edit", "user", "typo"), (2, 3, 0, "delta", "user", "!"), (2, 4, 9, "delta", None, "lone"),
    ]
    df = spark.createDataFrame(events, "conv_id long, seq long, turn long, kind string, role string, text string")
    got = defaultdict(list)
    for r in sorted(chat_format.fold_events(df).collect(), key=lambda r: (r.conv_id, r.position)):
        got[r.conv_id].append((r.role, r.text))
    assert got == {1: [("user", "hi"), ("assistant", "Bye")], 2: [("user", "typo!"), ("assistant", "ok"), ("", "lone")]}
    assert chat_format.read_back(chat_format.render(chat_format.fold_events(df.limit(0)))).count() == 0


def test_chat_of_one_long_conversation(spark):
    """30,000 events of one conversation, of which a regeneration near the end drops the tail: each row is folded once."""
    n = 30_000
    log = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("seq"), F.when(F.col("id") == n - 1, F.lit(n - 100)).otherwise(F.col("id")).alias("turn"), F.when(F.col("id") == n - 1, "regenerate").otherwise("message").alias("kind"), F.lit("user").alias("role"), F.lit("t").alias("text"))
    got = chat_format.fold_events(log.repartition(3)).agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("last"), F.sum(F.length("text")).alias("said")).first()
    assert (got.n, got["last"], got.said) == (n - 99, n - 100, n - 100)


def test_toxicity_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, f"{'bad' if i % 2 else 'good'} word{i} " + "filler " * 5) for i in range(60)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    whole = toxicity.fit_toxicity(docs, labels, F.lit(True))
    assert all((a == b) if isinstance(a, float) else (a == b).all() for a, b in zip(whole, toxicity.fit_toxicity(docs.repartition(7), labels, F.lit(True))))
    assert len(toxicity.fit_toxicity(docs, labels, F.lit(True), max_bytes=0)[0]) == 0


def test_encoder_equals_library():
    enc = tokens.encoder(TOK)
    odd = ["a  b", " x", " ", "\n\n a　 b \t c  ", "<|endoftext|> hi <|endoftext|>", "don't 'll we'll  'x", " é ü  z", "x \x1c y", "中文 字 🎉 🎉", "a _b -c  -d", "x '", "  "]
    for t in odd + [x for x in TEXTS if x]:
        assert enc.ids(t).tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids
    rng = random.Random(4)
    bits = ["a", "b", "The", " ", "  ", "\n", "\n\n", "\t", "\r", "'", "'s", "'re", "1", "22", ".", ",", "-é", "ß", "÷", "\0", "中", "_", "<|endoftext|>", " x", "A"]
    mixed = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(4000)]
    for t, ids in zip(mixed, enc.batch(pa.array(mixed)), strict=True):
        assert ids.tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids


def test_encoder_forgets_only_what_is_rare(monkeypatch):
    monkeypatch.setattr(tokens, "REPEATED", 10)
    monkeypatch.setattr(tokens, "NEW", 40)
    enc = tokens.Encoder(TOK)
    for k in range(60):
        t = f"the of w{k} and " + " ".join(f"rare{chr(97 + j)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for j in range(10))
        assert enc.ids(t).tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids
        assert len(enc.words) <= 10 and len(enc.words.old) <= 10 and len(enc.words.new) <= 40
    asked = []
    ask, enc.words.ask = enc.words.ask, lambda w: asked.append(w) or ask(w)
    enc.ids("the of")
    assert not asked


def test_packing(docs, empty):
    enc = tokens.encoder(TOK)
    got = packing.pack_documents(docs, TOK, 64, 0).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in enumerate(TEXTS):
        ids = np.append(enc.ids(t), 0).astype("<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and bytes(r.ids) == ids[at : at + r.length].tobytes()
            at += r.length
        assert at == len(ids)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert sum(sum(r.length for r in rows) < 64 for rows in by_seq.values()) <= 4  # one for each partition
    assert packing.pack_documents(empty, TOK, 64, 0).count() == 0


def test_packing_with_few_open_windows_and_other_ids(spark):
    texts = ["one two three " * (1 + i % 5) for i in range(60)]
    docs = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id int, text string").coalesce(1)
    got = packing.pack_documents(docs, TOK, 32, 0, max_open=2)
    assert got.schema["doc_id"].dataType.simpleString() == "int"
    used = Counter()
    for r in got.collect():
        used[r.sequence_id] += r.length
    enc = tokens.encoder(TOK)
    assert sum(used.values()) == sum(len(enc.ids(t)) + 1 for t in texts) and sorted(used.values())[1:] == [32] * (len(used) - 1)
    assert packing.pack_documents(docs.where("doc_id IS NULL").withColumn("doc_id", F.lit("x")), TOK, 32, 0).schema["doc_id"].dataType.simpleString() == "string"


def test_sum_of_squares_choice():
    rng = np.random.default_rng(1)
    packer, levels = packing.Packer(16), Counter()
    for k in range(400):
        size = int(rng.integers(1, 16))
        best = min(([sum(v * v for h, v in (levels - Counter([a] if a else []) + Counter([a + size] if a + size < 16 else [])).items() if h), -a] for a in [0, *(h for h, v in levels.items() if v)] if a + size <= 16))
        packer.add(k, np.zeros(size, "<u2"))
        levels = Counter({h: n for h, n in enumerate(packer.level_counts()) if n})
        assert sum(v * v for v in levels.values()) == best[0]
    small = packing.Packer(16, max_open=3)
    for k in range(100):
        small.add(k, np.zeros(int(rng.integers(1, 40)), "<u2"))
        assert small.open < 3
    small.cut_open()
    assert sum(len(x[2]) for x in small.out if x[0] == 5) == small.out[[x[0] for x in small.out].index(5)][3]


@pytest.mark.parametrize(("n", "symbols", "bits"), [(0, 1, 16), (1, 1, 16), (7, 1, 16), (255, 40, 7), (256, 300, 10), (257, 50_000, 16), (5000, 3000, 12), (32_768, 60_000, 16), (100_001, 50_000, 17)])
def test_huffman(n, symbols, bits):
    ids = (np.random.default_rng(n).zipf(1.3, n) % symbols).astype("<u2")
    counts = np.bincount(ids)
    seen = np.flatnonzero(counts)
    lengths = token_files.code_lengths(counts[seen], bits)
    assert len(seen) < 2 or (lengths.max() <= bits and sum(2.0**-x for x in lengths) == 1)
    code, width = token_files.canonical_codes(seen, lengths)
    payload, marks = token_files.encode_bits(ids, code, width)
    if n:
        assert (token_files.decode_bits(payload, marks, n, token_files.decode_table(seen, lengths)) == ids).all()


def test_token_files(spark, docs, empty):
    enc = tokens.encoder(TOK)
    folder = Scratch(spark, "test").path
    token_files.write_token_files(docs, folder, TOK, 2)
    at = 0
    for r in sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r.doc_id):
        ids = np.append(enc.ids(TEXTS[r.doc_id]), 2).astype("<u4")
        assert (r.start, r.n_tokens, bytes(r.ids)) == (at, len(ids), ids.tobytes())
        at += len(ids)
    folder = Scratch(spark, "test").path
    token_files.write_token_files(empty, folder, TOK, 2)
    assert token_files.read_token_files(spark, folder).count() == 0


def components_of(texts, k, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, k):
    sizes, want = components_of(TEXTS, k, 80)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs, k, 80).collect()}
    assert [got[i].n_shingles for i in range(len(TEXTS))] == sizes
    assert [got[i].component_id for i in range(len(TEXTS))] == want
    assert all(got[i].kept == (want[i] == i) for i in got)


def test_near_duplicates_chain_in_one_bucket(spark, empty):
    """Neighbours in a chain are similar, its ends are not: pairs with a bucket's ends alone would lose links."""
    rng = random.Random(5)
    words = [f"q{i}" for i in range(300)]
    texts = []
    for _ in range(40):
        words = list(words)
        for _ in range(9):
            words[rng.randrange(300)] = f"n{rng.random()}"
        texts.append(" ".join(words))
    sizes, want = components_of(texts, 2, 80)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (99, None)], "doc_id long, text string")
    got = near_dedup.near_duplicates(df, 2, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == {**dict(enumerate(want)), None: None, 99: 99}
    assert near_dedup.near_duplicates(empty, 2, 80).count() == 0
    assert sorted(str(r.doc_id) for r in near_dedup.drop_near_duplicates(df, 2, 80).collect()) == sorted([*(str(i) for i, w in enumerate(want) if i == w), "None", "99"])


def test_near_duplicates_of_rows_with_one_id(spark):
    """Rows with one id are one document, linked if any of its texts is."""
    rng = random.Random(8)
    a, b, c = (" ".join(f"{n}{rng.random()}" for _ in range(60)) for n in "abc")
    df = spark.createDataFrame([(5, a), (5, b), (7, a + " more"), (9, b + " more"), (3, b), (4, c), (4, c), (6, None), (6, c + " x"), (8, "")], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles > 0): (r.component_id, r.kept) for r in near_dedup.near_duplicates(df, 2, 80).collect()}
    assert got == {(5, True): (3, False), (7, True): (3, False), (9, True): (3, False), (3, True): (3, True), (4, True): (4, True), (6, False): (6, True), (6, True): (4, False), (8, False): (8, True)}
    assert sorted(r.doc_id for r in near_dedup.drop_near_duplicates(df, 2, 80).collect()) == [3, 4, 4, 8]


def test_rarest_shingles_of_similar_sets_meet(spark, monkeypatch):
    """Of two similar sets the first common shingle stands so far in front that what follows can make up the overlap."""
    monkeypatch.setattr(near_dedup, "SLOTS", 64)
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 62, 120)
    sets = [np.unique(np.r_[rng.permutation(base)[: int(rng.integers(95, 121))], rng.integers(0, 1 << 62, int(rng.integers(0, 30)))]) for _ in range(60)]
    df = spark.createDataFrame([(i, [int(v) for v in x]) for i, x in enumerate(sets)], "node long, shingles array<long>").repartition(3)
    cut = {r.node: r.shingles for r in near_dedup.rarest(df, 80).collect()}
    similar = 0
    for i, x in enumerate(sets):
        assert len(cut[i]) == len(x) - -(-80 * len(x) // 100) + 1 and set(cut[i]) <= set(x.tolist())
        for j, y in enumerate(sets[:i]):
            both = len(np.intersect1d(x, y))
            if 100 * both >= 80 * (len(x) + len(y) - both):
                similar += 1
                first = next(s for s in cut[i] if s in cut[j])
                assert min(len(x) - cut[i].index(first), len(y) - cut[j].index(first)) >= both
    assert similar > 50


def test_near_duplicates_that_share_a_passage(spark):
    """Texts that share a passage of two thirds of their words share buckets, but no link; copies among them do."""
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(120))
    texts = [f"{' '.join(f'u{rng.random()}' for _ in range(rng.randint(30, 60)))} {passage}" for _ in range(60)]
    texts += [t + " end of it" for t in texts[:10]]
    sizes, want = components_of(texts, 2, 80)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 2, 80).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want and len(set(want)) == 60


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(2)
    both = rng.integers(0, 1 << 63, 800, dtype=np.uint64)
    a, b = (np.unique(np.r_[both, rng.integers(0, 1 << 63, 100, dtype=np.uint64)]) for _ in range(2))
    x, y = (near_dedup.packed_bits(near_dedup.minima(s)).view(np.uint64) for s in (a, b))
    differ = sum(bin(int((v | v >> np.uint64(1)) & np.uint64(0x5555555555555555))).count("1") for v in x ^ y)
    assert abs((0.75 - differ / near_dedup.MINIMA) / 0.75 - 0.8) < 0.15


def test_decontamination(spark, docs, empty):
    items = [("b1", TEXTS[12]), ("b2", "One, two"), ("b3", None), ("b4", " ... "), ("b10", (TEXTS[13] or "") + " tail"), ("b5", TEXTS[12])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        w = word.findall(low(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(i)
    for limit in (1 << 20, 600):  # one automaton, then several
        for r in decontaminate.find_benchmark_passages(docs, bench, 10, max_bytes=limit).collect():
            text = TEXTS[r.doc_id]
            w = word.findall(low(text))
            hit, own = set(), set()
            for x, ids in windows.items():
                for k in range(len(w) - len(x) + 1):
                    if tuple(w[k : k + len(x)]) == x:
                        hit |= set(range(k, k + len(x)))
                        own |= ids
            assert (r.found.n_words, r.found.n_hit, r.found["items"]) == (len(w), len(hit), sorted(own))
            assert sum(len(word.findall(low(text[s.start : s.end]))) for s in r.found.spans) == len(hit)
    assert decontaminate.find_benchmark_passages(docs, bench.limit(0), 10).where("found.n_hit > 0").count() == 0
    assert decontaminate.find_benchmark_passages(empty, bench, 10).count() == 0
    kept = decontaminate.drop_contaminated(docs, bench, 10)
    assert kept.columns == docs.columns and 0 < kept.count() < len(TEXTS)


def test_quality_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, quality.N_FEATURES)).astype(np.float32)
    y = ((x[:, 3] > 0.2) ^ (x[:, 7] > 0)).astype(float)
    trees = quality.fit_trees(x[:1500], y[:1500])
    assert ((trees.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    row, at = x[1600], trees.base
    for t in range(len(trees.feature)):
        node = 0
        for _ in range(4):
            node = 2 * node + 1 + int(row[trees.feature[t, node]] > trees.threshold[t, node])
        at += trees.value[t, node - 15]
    assert abs(trees.score(row[None])[0] - 1 / (1 + np.exp(-at))) < 1e-9
    assert quality.fit_trees(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    for t in TEXTS:
        assert np.isfinite(quality.statistics(t)).all() and len(quality.statistics(t)) == quality.N_FEATURES


@pytest.mark.parametrize("module", ["quality", "toxicity"])
def test_classifiers_on_odd_rows(spark, docs, empty, module):
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(40)] + [(None, 1, True), (3, None, None)], "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    every = F.lit(True)
    if module == "quality":
        fit, score = (lambda d, l: quality.fit_quality(d, l, every)), quality.score_quality
    else:
        fit, score = (lambda d, l: toxicity.fit_toxicity(d, l, every)), toxicity.score_toxicity
    for d, l in ((docs, labels), (docs, labels.limit(0)), (empty, labels)):
        got = docs.select("doc_id", score(F.col("text"), fit(d, l)).alias("s")).collect()
        assert len(got) == len(TEXTS) and all(0 <= r.s <= 1 for r in got)


def test_ftrl_learns_and_is_sparse():
    rng = np.random.default_rng(0)
    model = toxicity.Ftrl()
    for _ in range(3000):
        y = float(rng.random() < 0.2)
        model.learn(np.unique([*rng.integers(1000, 5000, 50), *[7] * int(y)]), y)
    at, weight, _ = model.weights()
    assert 7 in at and weight[list(at).index(7)] > 1 and len(at) < 500


PAGES = [
    ("http://a.example/1", "<html><head><title>t</title></head><body><nav><ul><li>Menu</li></ul></nav><div class='ad'>buy</div><article><h1>One &amp; two</h1><p>First<p>Second <b>bold</b>\n text<br>third</article><footer>f</footer></body></html>", "One & two\nFirst\nSecond bold text\nthird"),
    ("http://a.example/2", "<html><head><title>t</title></head><body><nav><ul><li>Menu</li></ul></nav><div class='ad'>buy</div><article><h1>Other</h1><p>Same</p><script>x<y</script><form>no</form><p>&lt;b&gt;</article><footer>f</footer></body></html>", "Other\nSame\n<b>"),
    ("http://a.example/3", "<html><body><nav>Menu</nav><article><p>cut off &am", "cut off &am"),
    ("http://b.example/", "<body><header>top</header><aside>side</aside><p>Plain  page</p><div id=comments><p>me too</p></div>", "Plain page"),
    (None, "", ""),
    ("not a url", None, ""),
    ("http://c.example/", "no markup at all", "no markup at all"),
]


def test_html(spark, empty):
    rows = [(i, u, h, "clash", "clash") for i, (u, h, _) in enumerate(PAGES)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, row string")
    got = html_extract.extract_main_text(pages)
    assert got.columns == [*pages.columns, "main_text"]
    for r in got.collect():
        assert r.main_text == PAGES[r.page_id][2], r.page_id
    assert html_extract.extract_main_text(pages.limit(0)).count() == 0
    assert html_extract.blocks("<article>" + "<p>x" * 20_000, frozenset()) == ["x"] * 20_000
    assert html_extract.blocks("<article><p class=\"x>hi</p>", frozenset()) == ["hi"]  # a quote that nothing closes
    deep = list(html_extract.parse("<div class='c'>" * 5000 + "low"))
    assert max(len(node.key) for _, node, _ in deep) < 600 and "".join(text for _, _, text in deep) == "low"
    long = [next(html_extract.parse(f"<div class='{'a' * 200}{x}'>"))[1].key for x in "xy"]
    assert long[0] != long[1]


def extracted(spark, htmls):
    pages = spark.createDataFrame([(i, f"http://t.example/{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string").repartition(3)
    return [r.main_text for r in html_extract.extract_main_text(pages).orderBy("page_id").collect()]


def test_html_template_without_names(spark):
    """Menus, notices and footers of neutral names recur over the host; a notice is on every other page only."""
    note = "<div class='n2'><p>We use the biscuits that the site needs</p></div>"
    htmls = [f"<body><div class='x1'><p>Home News</p></div>{note if i % 2 else ''}<div class='c-204'><h1>Title {i}</h1><p>Text t{i} of u{i}</p></div><div class='x9'>All rights reserved</div></body>" for i in range(8)]
    assert extracted(spark, htmls) == [f"Title {i}\nText t{i} of u{i}" for i in range(8)]
    assert extracted(spark, htmls[:1] * 4) == ["Home News\nTitle 0\nText t0 of u0\nAll rights reserved"] * 4  # no slots


def template_by_brute_force(htmls):
    """Words on the same pages, equally often, as an element around them that is once on each, by sets of pages."""
    where, inside = defaultdict(dict), {}
    for i, page in enumerate(htmls):
        stack = []
        for kind, node, text in html_extract.parse(page):
            if kind == "open":
                stack.append(node.key)
            elif kind == "close":
                where["close", stack.pop()].setdefault(i, 0)
            if kind in ("open", "close"):
                own = where[kind, node.key]
                own[i] = own.get(i, 0) + 1
            for word in text.split():
                own = where["word", node.key, word]
                own[i] = own.get(i, 0) + 1
                inside[node.key, word] = list(stack)
    valid = {k[1]: set(v) for k, v in where.items() if k[0] == "open" and len(v) >= 3 and set(v.values()) == {1} and where["close", k[1]] == v}
    return {(k[1], k[2]) for k, v in where.items() if k[0] == "word" and len(set(v.values())) == 1 and any(valid.get(e) == set(v) for e in inside[k[1], k[2]])}


@pytest.mark.parametrize("held", [1, 500_000])
def test_html_templates_against_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(html_extract, "HELD", held)
    rng = random.Random(6)
    parts = ["<div class='m'>Home News</div>", "<div class='n'>We use biscuits</div>", "<p>same line</p>", "<ul class='l'><li>one two</li></ul>"]
    hosts = {f"h{h}.example": [f"<body>{''.join(x for x in parts if rng.random() < 0.7)}<div class='t'>By a{rng.random()} on site</div><p>w{i} text {rng.choice('xyz')}</p></body>" for i in range(rng.randint(2, 9))] for h in range(6)}
    rows = [(f"http://{h}/{i}", x) for h, pages in hosts.items() for i, x in enumerate(pages)]
    pages = spark.createDataFrame([(i, u, x) for i, (u, x) in enumerate(rows)], "page_id long, url string, html string").repartition(3)
    names = {r.h: r.host for r in spark.createDataFrame([(h,) for h in hosts], "host string").select("host", F.xxhash64("host").alias("h")).collect()}
    got = {names[r.host]: set(r.words) for r in html_extract.templates(pages, Scratch(spark, "test")).collect()}
    for h, own in hosts.items():
        want = {html_extract._hash(f"path {key}") ^ html_extract._hash(word) for key, word in template_by_brute_force(own)}
        assert got.get(h, set()) == want
    assert sum(map(len, got.values())) > 20


@pytest.mark.parametrize("teaser, own", [("<aside><article><p>Teaser {i}</p></article></aside>", ""), ("<div class='related'><article>Card {i}</article></div>", ""), ("<article><p>Card {i}</p></article>", "Card {i}\n")])
def test_html_teaser_article_beside_a_div(spark, teaser, own):
    htmls = [f"<body>{teaser.format(i=i)}<div class='c'><h1>Title {i}</h1><p>The text of t{i} is here</p></div></body>" for i in range(6)]
    want = [f"{own.format(i=i)}Title {i}\nThe text of t{i} is here" for i in range(6)]
    assert extracted(spark, htmls) == want
    assert ["\n".join(html_extract.blocks(h, frozenset())) for h in htmls] == want


def articles(article, n=8, seed=3):
    """Pages whose menu, advert and footer differ on each page, and the text of ``article`` (with {0}) around the words."""
    rng = random.Random(seed)
    some = lambda k: " ".join(f"w{rng.randrange(5000)}" for _ in range(k))
    texts = [(some(4), some(40), some(25)) for _ in range(n)]
    htmls = [f"<html><body><div class='q1'><p>{some(3)}</p><p>{some(2)}</p></div><div class='q2'>Offer {some(5)}</div>{article.format(f'<h1>{a}</h1><p>{b}</p><p>{c}</p>')}<div class='q3'>All rights {some(2)}</div></body></html>" for a, b, c in texts]
    return htmls, ["\n".join(x) for x in texts]


@pytest.mark.parametrize("article", ["<div class='z7'>{0}</div>", "<div class='z7'><section class='z8'>{0}</section></div>", "<article>{0}</article>"])
def test_html_place_of_what_varies(spark, monkeypatch, article):
    """Menus and adverts of neutral names that vary on every page go, as the template shows where most of what varies is."""
    htmls, want = articles(article)
    assert extracted(spark, htmls) == want
    monkeypatch.setattr(html_extract, "BROADCAST_LIMIT", -1)  # templates too large to tell to all tasks
    assert extracted(spark, htmls) == want


def test_html_without_names(spark, monkeypatch):
    """With all lists of names emptied the template alone finds the articles of the driver's pages."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    host = F.xxhash64(html_extract.host_of(F.col("url")))
    kept = {r.page_id: r.main_text for r in html_extract.extract_main_text(pages).collect()}
    found = {r.host: (frozenset(r.words), frozenset(r.places)) for r in html_extract.templates(pages, Scratch(spark, "test")).collect()}
    assert found and all(places for _, places in found.values())
    plain = html_extract._element

    def nameless(name, attrs, parent):
        node = plain(name, attrs, parent)
        node.drop, node.main, node.named = parent.drop or name in html_extract._RAW or name == "head", False, False
        return node

    monkeypatch.setattr(html_extract, "_element", nameless)
    rows = [(r.page_id, r.html, found[r.host]) for r in pages.withColumn("host", host).collect() if r.host in found]
    lost = sum("\n".join(html_extract.blocks(page, *own)) != kept[i] for i, page, own in rows)
    without = sum("\n".join(html_extract.blocks(page, frozenset())) != kept[i] for i, page, _ in rows)
    assert len(rows) > 10 and lost <= 0.05 * len(rows) and without > 0.9 * len(rows)


def test_html_boilerplate_names_in_the_main_element(spark):
    """Inside an article a class name alone drops nothing; recurring text of such a class goes."""
    htmls = [f"<body><article><div class='article-header'><h1>Title {i}</h1></div><p>Text t{i}</p><section class='related-work'><p>Work w{i}</p></section><div class='side-by-side'>Both b{i}</div><p class='alert'>Mind m{i}</p><div class='share'>Share this page</div><p>See also</p></article><div class='ad'>buy x{i}</div></body>" for i in range(6)]
    assert extracted(spark, htmls) == [f"Title {i}\nText t{i}\nWork w{i}\nBoth b{i}\nMind m{i}\nSee also" for i in range(6)]


def test_decontamination_fetches_groups_one_at_a_time(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta")], "doc_id long, text string")
    bench = spark.createDataFrame([(f"i{k}", f"w{k} " * 40) for k in range(12)] + [("hit", "beta gamma")], "item_id string, text string")
    frame, seen = type(docs), []
    for at, name in ((frame, "toLocalIterator"), (Scratch, "write")):
        monkeypatch.setattr(at, name, lambda *a, f=getattr(at, name), name=name, **b: seen.append(name) or f(*a, **b))
    row = decontaminate.find_benchmark_passages(docs, bench, 10, max_bytes=500).first()
    n = seen.count("toLocalIterator")
    assert n > 2 and seen == ["toLocalIterator", "write"] * (n - 1) + ["toLocalIterator"]
    assert row.found["items"] == ["hit"]
