"""URL filter, alignment and fill-in-middle against plain Python on small tables: nulls, empty and long texts, ties, repeats, clashes."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gridregimes.llm import alignment, chat_format, fill_in_middle, near_dedup, perfect_hash, token_files, url_filter
from gridregimes.llm.common import Scratch
from gridregimes.llm.url_filter import Rule

PATHS = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
SCHEMA = "doc_id long, text string, a string, keys string, n int, fim string"
TEXTS = [None, "", " ", "a", "\n", "\n\n a", "a ", "  a  b", "<P>x", "a<S>", "<M", "<<S", "é", "日本 語", "😀😀", "\0 \0", "a▁b", "<s>hi</s><|endoftext|>", "= " * 300, "x" * 3000, " " * 500, "One two, three.\nFour! " * 40]


def made(seed, n):
    rng = random.Random(seed)
    parts = list("ab C.,'s\n\t é日😀<|>_01 ") + [" the", " hello", "<S>", "<P", "M>", "</s>", "  "]
    return ["".join(rng.choices(parts, k=rng.randint(0, 80))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    texts = TEXTS + made(1, 150) + made(1, 20)
    rows = [(i, t, "clash", "clash", 1, "clash") for i, t in enumerate(texts)] + [(7, "again and again", "", "", 1, ""), (7, "again and again", "", "", 1, ""), (None, "no id", "", "", 1, "")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def fim_by_hand(key, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle(spark, docs):
    out = fill_in_middle.fim_documents(docs)
    assert out.columns == ["doc_id", "text", "a", "keys", "n", "fim"]
    rows = out.select("*", fill_in_middle.restore_text(F.col("fim.output"), F.col("fim.form")).alias("back")).collect()
    assert len(rows) == docs.count() and {r.fim.form for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        assert tuple(r.fim) == fim_by_hand("" if r.doc_id is None else r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert fill_in_middle.fim_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rotations_exchange_segments(monkeypatch):
    rng = random.Random(4)
    for at_once in (1, 3, 1 << 16):
        monkeypatch.setattr(fill_in_middle, "AT_ONCE", at_once)
        for _ in range(200):
            data = bytes(rng.randrange(256) for _ in range(rng.randint(0, 30)))
            i, j, k = sorted(rng.randint(0, len(data)) for _ in range(3))
            turned = bytearray(data)
            fill_in_middle.rotate(turned, i, j, k)
            assert turned == data[:i] + data[j:k] + data[i:j] + data[k:]
            fill_in_middle.rotate(turned, i, i + k - j, k)
            assert turned == data


def groups_by_hand(text):
    """[(ids of one side, ids of the other), ...] by walking over bytes."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    if not text:
        return []
    a, b = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    names = {c: k for k, c in enumerate(alignment.byte_names())}
    ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)]
    parts = [[bytes(names[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]]
    if any(b"".join(x) != (" " + text).encode() for x in parts):
        return []
    ends = [np.cumsum(list(map(len, x))).tolist() for x in parts]
    out, done = [], [0, 0]
    for end in sorted(set(ends[0]) & set(ends[1])):
        upto = [x.index(end) + 1 for x in ends]
        out.append(tuple(ids[s][done[s] : upto[s]] for s in (0, 1)))
        done = upto
    return out


@pytest.mark.parametrize("limits", [{}, {"SLICE": 20, "ROUND": 4000, "HELD": 40}], ids=["usual", "many slices and rounds"])
def test_alignment(docs, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(alignment, name, value)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    groups = [groups_by_hand(t) for _, t in rows]
    links = [[(x, y) for a, b in g for x in a for y in b] for g in groups]
    counts = Counter(pair for x in links for pair in set(x))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    want = []
    for (doc, _), g, own in zip(rows, groups, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        want.append((doc, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(own), sum(counts[x] == best[x[0]] for x in own), sum(counts[x] for x in own), text))
    got = alignment.align_tokenizers(docs, *PATHS).drop("a", "b").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_alignment_without_tokens(spark):
    assert alignment.align_tokenizers(spark.createDataFrame([], SCHEMA), *PATHS).collect() == []
    rows = alignment.align_tokenizers(spark.createDataFrame([("k", None), ("l", "")], "doc_id string, text string"), *PATHS).collect()
    assert sorted(map(tuple, (r[:1] + r[3:] for r in rows))) == [("k", 0, 0, 0, 0, 0, 0, ""), ("l", 0, 0, 0, 0, 0, 0, "")]


def test_documents_with_very_many_links(monkeypatch):
    rng = np.random.default_rng(2)
    size_a, size_b = rng.integers(1, 6, 40), rng.integers(1, 6, 30)
    sides = [[], []]
    for _ in range(30):
        total = int(rng.integers(0, 60))
        for side, size in ((0, size_a), (1, size_b)):
            ids, left = [], total
            while left:
                fit = np.flatnonzero(size <= left)
                if not len(fit):
                    break
                ids.append(int(rng.choice(fit)))
                left -= int(size[ids[-1]])
            sides[side].append(ids if not left else None)
    kept = [(a, b) for a, b in zip(*sides) if a is not None and b is not None]
    batch = alignment.Batch(*(np.array([i for x in kept for i in x[s]], np.uint32) for s in (0, 1)), *(np.array([len(x[s]) for x in kept]) for s in (0, 1)), size_a, size_b)
    want = [sorted((int(d), int(k), int(n)) for block in batch.links(30) for d, k, n in zip(*block))]
    for large, links in ((1, 1), (3, 10), (1 << 12, 1)):
        monkeypatch.setattr(alignment, "LARGE", large)
        monkeypatch.setattr(alignment, "LINKS", links)
        want.append(sorted((int(d), int(k), int(n)) for block in batch.links(30) for d, k, n in zip(*block)))
    assert want[0] and all(x == want[0] for x in want) and len({x[:2] for x in want[0]}) == len(want[0])
    assert sum(n for _, _, n in want[0]) == int((batch.in_a * batch.in_b).sum())


def test_piece_encoder_against_the_library():
    pair = alignment.Pair(*PATHS)
    texts = [x for x in TEXTS + made(9, 400) if x]
    assert [x.tolist() for x in pair.b.batch(texts)] == pair.b.model.encode(texts)
    assert pair.b.by_word


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 32, 20_000).astype(np.uint32))
    own = (keys % 5).astype(np.int64)
    chosen = [0, 2, 3]
    index = perfect_hash.Slices(chosen, 5, *zip(*(perfect_hash.build(keys[own == s]) for s in chosen)))
    slots, here = index.slots(keys, own), np.isin(own, chosen)
    assert sorted(slots[here]) == list(range(here.sum())) and (slots[~here] == -1).all()
    assert (index.keys[slots[here]] == keys[here]).all()
    other = np.setdiff1d(np.arange(50_000, dtype=np.uint32), keys)
    assert (index.slots(other, (other % 5).astype(np.int64)) == -1).all()
    assert index.slots(keys[:0], own[:0]).tolist() == []
    assert len(index.words) * 64 < 4 * len(index.keys)


RULES = [Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"), Rule("net", "/es/", "block"), Rule("net", "/fr/", "block")]


def made_urls():
    rng = random.Random(8)
    hosts = ["a.com", "Example.COM", "www.example.com", "x.www.example.com", "b.example.com", "notexample.com", "c.net", "d.org", "spam.org", "net", "é.org"]
    urls = [None, "", "no scheme", "://", "http://", "http://a.com", "http://a.com?x", "HTTP://A.com/#f", "a.com/x://y.net/fr/", "http://d.org/" + "long/" * 400, "x\ny://d.org/a\nb"]
    for _ in range(300):
        host, lang = rng.choice(hosts), rng.choice(["en", "fr", "es", "de"])
        urls.append(f"{rng.choice(['http', 'https'])}://{host}/{lang}/{rng.randint(0, 60)}{rng.choice(['', '?q=1', '#t', '.html'])}")
    return urls + urls[:40]


def judged_by_hand(urls, order=5):
    """[(host, path, rule, verdict)], with counts in plain dictionaries and the formula written out recursively."""
    rows = []
    for url in urls:
        url = url or ""
        host, path, text = "", "", url
        if "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"(?s)[^/?#]*", rest)[0]
            path = re.match(r"(?s)[^?#]*", rest[len(host) :])[0]
            lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
            host, text = lower, lower + rest[len(host) :]
        fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rows.append((host, path, text, max(fits, key=lambda r: len(r.name), default=None)))
    held = lambda text: hashlib.md5(text.encode()).hexdigest()[0] < "4"
    labelled = {(text, rule.action) for _, _, text, rule in rows if rule}

    def positions(text):
        marked = "\x02" + text + "\x03"
        return [(marked[max(i - order, 0) : i], marked[i]) for i in range(1, len(marked))]

    counts = {"allow": defaultdict(Counter), "block": defaultdict(Counter)}
    for text, action in labelled:
        if not held(text):
            for context, c in positions(text):
                for k in range(len(context) + 1):
                    counts[action][context[k:]][c] += 1

    def share(model, context, c):
        seen = model.get(context, Counter())
        less = share(model, context[1:], c) if context else 1 / 256
        n, t = sum(seen.values()), len(seen)
        return (seen[c] + t * less) / (n + t) if n else less

    def score(text):
        ratios = [math.floor((math.log(share(counts["allow"], *x)) - math.log(share(counts["block"], *x))) * (1 << 20) + 0.5) for x in positions(text)]
        return sum(ratios) / len(ratios) / (1 << 20)

    tried = [(max(-512, min(512, math.floor(score(text) * 64))), action) for text, action in labelled if held(text)]
    all_of = Counter(a for _, a in tried)

    def errors(step):
        return sum(a == "allow" and s < step for s, a in tried) * all_of["block"] + sum(a == "block" and s >= step for s, a in tried) * all_of["allow"]

    threshold = min(range(-512, 513), key=lambda s: (errors(s), abs(s), s)) / 64
    return [(host, path, rule and rule.name, rule.action if rule else "allow" if score(text) >= threshold else "block") for host, path, text, rule in rows]


def test_url_filter(spark, monkeypatch):
    urls = made_urls()
    pages = spark.createDataFrame([(i % 330, u, "clash", "clash", 3) for i, u in enumerate(urls)], "page_id long, url string, host string, rule string, n int").repartition(3)
    want = sorted(str((i % 330, u, *x)) for (i, u), x in zip(enumerate(urls), judged_by_hand(urls)))
    for hot, piece in ((20_000, 256), (50, 7)):  # with few pairs told to all tasks, and with URLs in many pieces
        monkeypatch.setattr(url_filter, "HOT", hot)
        monkeypatch.setattr(url_filter, "PIECE", piece)
        got = url_filter.judge_urls(pages, RULES)
        assert sorted(str(tuple(r)[:6]) for r in got.collect()) == want
    assert {x.split(", ")[-1] for x in want if "None, '" in x} == {"'allow')", "'block')"}
    kept = url_filter.keep_allowed(pages, RULES)
    assert kept.columns == pages.columns and kept.count() == sum("'allow')" in x for x in want)


def test_url_filter_learns_from_examples(spark):
    """Held-out accuracy on URLs that no rule judges."""
    rng = random.Random(5)
    word = lambda letters: "".join(rng.choices(letters, k=rng.randint(4, 9)))
    good, bad = ([f"https://{word(x)}.org/{word(x)}/{word(x)}.html" for _ in range(400)] for x in ("aeioulmnrst", "xzqkwvjyp0"))
    examples = spark.createDataFrame([(u, "allow") for u in good[:200]] + [(u, "block") for u in bad[:200]], "url string, action string")
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(good[200:] + bad[200:])], "page_id long, url string")
    right = [(r.verdict == "allow") == (r.page_id < 200) for r in url_filter.judge_urls(pages, [], examples).collect()]
    assert len(right) == 400 and np.mean(right) > 0.97


def test_url_filter_without_anything(spark):
    schema = "page_id long, url string"
    assert url_filter.judge_urls(spark.createDataFrame([], schema), RULES).collect() == []
    rows = url_filter.judge_urls(spark.createDataFrame([(1, "http://x.org/a"), (None, None), (None, None)], schema), []).collect()
    assert [(r.rule, r.verdict, r.score) for r in rows] == [(None, "allow", 0.0)] * 3


def test_url_filter_uses_no_python(spark):
    plan = url_filter.judge_urls(spark.createDataFrame([(1, "http://x.org/a")], "page_id long, url string"), RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_near_duplicates_with_frequent_keys(spark, monkeypatch):
    """Many documents in one bucket and with one rarest shingle, dealt over tasks: the same components."""
    rng = random.Random(12)
    words = [f"v{i}" for i in range(400)]
    base = [rng.choices(words, k=30) for _ in range(25)]
    texts = [" ".join(b[:j] + [rng.choice(words)] + b[j + 1 :]) for b in base for j in rng.sample(range(30), 5)]
    shared = rng.choices(words, k=40)
    texts += [" ".join(shared + rng.choices(words, k=rng.randint(6, 12))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = sorted(map(tuple, near_dedup.near_duplicates(docs, 2, 80).collect()))
    sets = [{(a, b) for a, b in zip(t.split(), t.split()[1:])} for t in texts]
    root = list(range(len(texts)))
    for _ in root:
        for i, s in enumerate(sets):
            for j in range(i):
                both = len(s & sets[j])
                if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                    root[i] = root[j] = min(root[i], root[j])
        if all(root[x] == x for x in set(root)):
            break
    assert [r[2] for r in want] == root and 10 < len(set(root)) < len(texts)
    monkeypatch.setattr(near_dedup, "HUB", 3)
    assert sorted(map(tuple, near_dedup.near_duplicates(docs, 2, 80).collect())) == want


def test_a_family_that_is_not_quite_similar_gives_few_candidates(spark, monkeypatch):
    """60 texts with pairs at some 0.72: they share bands and rare shingles, but hardly a pair is left to be confirmed."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(200)]
    texts = [[f"v{t}x{i}" if rng.random() < 0.04 else w for i, w in enumerate(base)] for t in range(60)] + [base[:180]]
    sets = [set(zip(x, x[1:])) for x in texts]
    alike = [(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = list(range(len(sets)))
    for _ in root:
        for i, j in alike:
            root[i] = root[j] = min(root[i], root[j])
    counts, write = {}, Scratch.write

    def counted(self, df, name, *args):
        found = write(self, df, name, *args)
        counts[name] = found.count()
        return found

    monkeypatch.setattr(Scratch, "write", counted)
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, 2, 80).collect()} == dict(enumerate(root))
    assert counts["pairs3"] <= 2 * len(alike)


def test_parities_lose_no_link():
    rng = np.random.default_rng(6)
    for n in (0, 1, 40, 3000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for k in (0, 1, 9, 200):
            b = np.concatenate([a[k:], rng.integers(0, 1 << 63, k, dtype=np.uint64)])
            odd = (near_dedup.parities(a) ^ near_dedup.parities(b)).view(np.uint64)
            assert int(np.bitwise_count(odd).sum()) <= len(set(a) ^ set(b))


def test_spread_keeps_a_join(spark):
    many = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(5000)], "k long, i long")
    few = spark.createDataFrame([(k, f"x{k}") for k in range(0, 5000, 2)] + [(1, "one"), (1, "other")], "k long, x string")
    plain = sorted(map(tuple, many.join(few, "k").select("k", "i", "x").collect()))
    dealt, copied = near_dedup.spread(many, few, "k", "i", Scratch(spark, "test"), "hubs")
    assert sorted(map(tuple, dealt.join(copied, ["k", "salt"]).select("k", "i", "x").collect())) == plain
    assert max(r["count"] for r in dealt.groupBy("k", "salt").count().collect()) < 1300 and copied.where("k = 1").count() == 8


def test_token_files_tell_null_ids_from_all_others(spark):
    least = -(2**63)
    docs = spark.createDataFrame([(least, "a"), (None, "b"), (0, None), (None, ""), (least, "again")], "doc_id long, text string")
    folder = Scratch(spark, "test").path
    token_files.write_token_files(docs, folder, PATHS[0], 2)
    got = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, least, least, 0] and [r.n_tokens for r in got][-1] == 1


def test_chat_events_without_seq_or_turn(spark):
    events = [(1, None, 5, "message", "user", "first"), (1, 2, None, "message", "user", "kept"), (1, 3, 1, "message", "user", "ask"), (1, 4, 2, "message", "assistant", "gone"), (1, 5, 1, "regenerate", "user", None), (1, 6, 1, "delta", "user", "ask again")]
    df = spark.createDataFrame(events, "conv_id long, seq long, turn long, kind string, role string, text string")
    got = [r.text for r in chat_format.fold_events(df).orderBy("position").collect()]
    assert "kept" in got and "ask again" in got and "gone" not in got and len(got) == len(set(got))
