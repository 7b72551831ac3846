"""Each operator against a brute-force version, and on nulls, empty and repeated rows."""

import binascii
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import (
    chat, decontamination, mixing, near_duplicates, quality, sharding, token_counts, token_files, tokens, url_templates,
    vectors,
)
from ledgerlens.llm.common import cluster
from ledgerlens.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, slot long, part int, start long"


def documents(spark, texts, sources=None, ids=None):
    rows = [
        (ids[i] if ids else i, t, "en", sources[i] if sources else f"s{i % 3}", len(t or ""), "x", 1, 2, 3)
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, DOCS)


def prose(seed, words, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(words))


ODD = [None, "", " ", "one", "a b c d", "\n\t", prose(1, 30), prose(1, 30), prose(2, 20_000), "é ñ\u00a0ß 中文 🙂", "x" * 50_000]


# -- 1: decontamination -------------------------------------------------------

def brute_hits(doc, items, window=10):
    words = decontamination.words_of(doc.encode() if doc is not None else None)
    hit, found = set(), set()
    for item, text in items:
        own = decontamination.words_of(text.encode() if text is not None else None)
        k = min(window, len(own))
        grams = {tuple(own[i:i + k]) for i in range(len(own) - k + 1)} if k else set()
        for i in range(len(words) - k + 1 if k else 0):
            if tuple(words[i:i + k]) in grams:
                hit |= set(range(i, i + k))
                found.add(item)
    return len(words), len(hit), found - {None}


@pytest.mark.parametrize("block_bytes", [decontamination.BLOCK_BYTES, 40])
def test_decontamination_is_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 13)
    monkeypatch.setattr(decontamination.automata, "__defaults__", (block_bytes,))
    r = random.Random(5)
    items = [(i, " ".join(r.choice("abc") for _ in range(r.choice([0, 1, 4, 9, 10, 11, 40])))) for i in range(12)]
    items = [(i, t) for i, t in items if len(t.split()) != 1] + [(99, None), (None, "q r s"), (3, items[3][1])]
    texts = [" ".join(r.choice("abc") for _ in range(r.randrange(60))) for _ in range(40)] + ["Q, R! s é", None, "", "ABC"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.contamination(documents(spark, texts), bench).collect()}
    for i, t in enumerate(texts):
        n, hit, found = brute_hits(t, items)
        ids = ",".join(sorted(map(str, found)))
        row = got[i]
        assert (row.n_words, row.n_hit, row.n_items) == (n, hit, len(found))
        assert row.items_sha256 == hashlib.sha256(ids.encode()).hexdigest()
        assert row.contaminated == (hit > 0)


def test_decontamination_cuts_spans_and_drops_covered_documents(spark):
    passage = " ".join(f"p{i}" for i in range(15))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    texts = [f"Before it, {passage.upper()}! After.", passage, "clean text", None, ""]
    got = {r.doc_id: r for r in decontamination.decontaminate(documents(spark, [prose(3, 40) + " " + texts[0], *texts[1:]]), bench).collect()}
    assert set(got) == {0, 2, 3, 4}
    assert got[0].text == prose(3, 40) + " Before it, ! After." and got[0].n_chars == len(got[0].text)
    assert got[2].text == "clean text" and got[3].text is None and got[4].text == ""
    empty = decontamination.contamination(documents(spark, ["a"]).limit(0), bench.limit(0))
    assert empty.count() == 0


# -- 2: chat ------------------------------------------------------------------

def test_escape_round_trip():
    r = random.Random(1)
    for _ in range(3000):
        t = "".join(r.choice(["\\", "|", "<s>", "</s>", "[INST]", "[/INST]", "[", "<", "a", "\n", "é"]) for _ in range(r.randrange(12)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROLS)


def test_chat_reads_back_long_and_odd_conversations(spark):
    rows = [(1, 0, "user", "hi </s>[INST] ok"), (1, 1, "assistant", None), (1, 2, None, "\\|"), (None, 0, "user", "x"),
            (2, 0, "user", "same"), (2, 0, "user", "same"), (2, None, "assistant", "early")]
    rows += [(3, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(41)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    shown = chat.format_conversations(df, segment_turns=4)
    assert not any(r.rewrites_history for r in shown.collect())
    got = {r.conv_id: r for r in chat.digest(shown).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_rewriting_templates_are_found():
    last_only = lambda m: "".join(f"<{r}>{t}" if i == len(m) - 1 else f"<{r}>" for i, (r, t) in enumerate(m))
    assert chat.spans(last_only, [("a", "one"), ("b", "two")])[2]
    text, found, rewritten = chat.spans(chat.bracket_template, [("user", "[INST]"), ("assistant", "é")])
    assert not rewritten and [chat.unescape(text[a:b]) for a, b in found] == ["[INST]", "é"]


# -- 3: quality ---------------------------------------------------------------

def test_quality_on_held_out_rows(spark):
    r = random.Random(2)
    texts, labels = [], []
    for i in range(900):
        kind = i % 3
        words = prose(i, 60).split()
        if kind == 0:
            words[r.randrange(60)] = r.choice(["badword", "badterm", "badname"])
        if kind == 1:
            words = [w.upper() + "!!" for w in words]
        texts.append(" ".join(words))
        if i < 600:
            labels.append((i, 0 if kind == 1 else 1, 1 if kind == 0 else 0))
    rated = spark.createDataFrame(labels + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.rate(documents(spark, [*texts, None, ""]), rated).collect()}
    assert len(got) == 902
    held = range(600, 900)
    assert sum(got[i].kept == (i % 3 == 2) for i in held) > 0.97 * 300
    mean = [np.mean([got[i].expected_grade for i in held if i % 3 == k]) for k in (0, 1, 2)]
    assert mean[0] < mean[1] < mean[2]
    same = {x.doc_id: x.tail_probability for x in quality.rate(documents(spark, texts), rated).collect()}
    assert all(same[i] == got[i].tail_probability for i in held)


def test_quality_without_labels(spark):
    rated = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.rate(documents(spark, ODD), rated).count() == len(ODD)


# -- 4 and 8: tokens ----------------------------------------------------------

def odd_texts(n=3000):
    r = random.Random(3)
    bits = [*"ab é1,.!'s\n\t  \x0b\xa0\u180eßĀ中🙂\u0301\r", "<|endoftext|>", " the", "'s", " 12", "\n\n", " \n", "İ", "ǅ", "\x1c",
            "\u200b", "  ", "x.\nY", "tion,", "won't", "A"]
    return ["".join(r.choice(bits) for _ in range(r.randrange(40))) for _ in range(n)]


def test_encoders_agree_with_the_library(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_PARTS", 500)
    texts = odd_texts() + [t for t in ODD if t is not None]
    ids, counts = tokens.SpaceEncoder(vocabulary("byte_bpe_50k.json")), tokens.Counter(vocabulary("word_bpe_49k.json"))
    for start in range(0, len(texts), 100):
        part = texts[start:start + 100]
        want = ids.tokenizer.encode_batch(part, add_special_tokens=False)
        assert ids.ids(pa.array(part, pa.string()), 0).to_pylist() == [e.ids + [0] for e in want]
        assert counts.counts(part) == [len(e.ids) for e in counts.tokenizer.encode_batch(part, add_special_tokens=False)]


def test_token_counts(spark):
    path = vocabulary("word_bpe_49k.json")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in token_counts.count_tokens(documents(spark, ODD), path, 100).collect()}
    for i, t in enumerate(ODD):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 100)
    assert token_counts.count_tokens(documents(spark, ODD).limit(0), path).count() == 0


def test_token_files(spark):
    path = vocabulary("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    ids = [5, 3, None, 3, 0, 9, 2, 8, 7, 6, 11]
    got = token_files.store_and_digest(documents(spark, ODD, ids=ids), path).orderBy("start").collect()
    want = {}
    for d, t in zip(ids, ODD):
        row = library.encode(t or "", add_special_tokens=False).ids + [0]
        want.setdefault(d, []).append((len(row), zlib.crc32(np.array(row, "<u4").tobytes())))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert all(sorted((r.n_tokens, r.ids_crc32) for r in got if r.doc_id == d) == sorted(v) for d, v in want.items())
    assert token_files.store_and_digest(documents(spark, ODD).limit(0), path).count() == 0


# -- 5: neighbours ------------------------------------------------------------

def exact_nearest(rows, queries, k=5):
    keep = {i: np.array(v, dtype=float) for i, v in rows.items()}
    out = {}
    for q in queries:
        scored = sorted((-(keep[q] @ v) / np.linalg.norm(keep[q]) / np.linalg.norm(v), i) for i, v in keep.items() if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_neighbours_recall_and_odd_rows(spark):
    r = np.random.default_rng(0)
    rows = {i: r.standard_normal(16).tolist() for i in range(3000)}
    bad = [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [float("nan")] * 16), (5004, [None] * 16), (5005, [1.0] * 3), (None, [1.0] * 16)]
    df = spark.createDataFrame([*rows.items(), *bad, (7, rows[7])], "vec_id long, embedding array<double>")
    got = {}
    for x in vectors.nearest(df, F.col("vec_id") % 50 == 0, block_rows=700).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    want = exact_nearest(rows, [i for i in rows if i % 50 == 0])
    assert set(got) == set(want)
    found = total = 0
    for q, best in want.items():
        mine = sorted(got[q])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        for _, v, s in mine:
            a, b = np.array(rows[q]), np.array(rows[v])
            assert abs(s - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12
        found += len({m[1] for m in mine} & {i for i, _ in best})
        total += 5
    assert found >= 0.9 * total


def test_neighbours_of_few_rows_are_exact(spark):
    rows = {i: [float(i % 3 + 1), float(i)] for i in range(4)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<float>")
    got = [(x.query_id, x.vec_id) for x in vectors.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, i) for i, _ in exact_nearest(rows, [0])[0]]
    assert vectors.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


# -- 6: near-duplicates -------------------------------------------------------

def brute_groups(texts, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(lower)) if x]
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a in range(len(texts)):
            for b in range(a):
                shared = len(sets[a] & sets[b])
                if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return [len(s) for s in sets], label


@pytest.mark.parametrize("small,block", [(near_duplicates.SMALL_NODE, near_duplicates.BLOCK), (2, 4)])
def test_near_duplicates_are_brute_force(spark, monkeypatch, small, block):
    monkeypatch.setattr(near_duplicates, "SMALL_NODE", small)
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    r = random.Random(7)
    texts = list(ODD)
    for base in range(12):
        words = prose(100 + base, r.choice([3, 8, 60, 200])).split()
        for _ in range(r.randrange(1, 14)):
            copy = list(words)
            for _ in range(r.randrange(0, max(1, len(words) // 40) + 1)):
                copy[r.randrange(len(copy))] = f"n{r.randrange(10**6)}"
            texts.append(" ".join(copy))
    sizes, label = brute_groups(texts, 80)
    got = {x.doc_id: x for x in near_duplicates.near_duplicates(documents(spark, texts), 80).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == label
    assert all(got[i].kept == (label[i] == i) for i in got)


def test_near_duplicates_with_odd_ids(spark):
    ids, texts = [4, 4, None, 2, 7], ["a b c d e f"] * 3 + ["z y x w v"] + ["a b c d e f"]
    rows = documents(spark, texts, ids=ids)
    got = sorted((str(x.doc_id), x.component_id, x.kept) for x in near_duplicates.near_duplicates(rows).collect())
    assert got == sorted([("4", 4, True), ("4", 4, True), ("None", None, None), ("2", 2, True), ("7", 4, False)])
    assert sorted(str(x.doc_id) for x in near_duplicates.keep_one(rows).collect()) == ["2", "4", "None"]
    assert near_duplicates.near_duplicates(rows.limit(0)).count() == 0
    assert near_duplicates.miss_probability(0.8) < 1e-9


def test_cluster_asks_enough():
    r = random.Random(4)
    for _ in range(200):
        n = r.randrange(1, 30)
        links = {i: {i} for i in range(n)}
        for _ in range(r.randrange(0, 30)):
            a, b = r.randrange(n), r.randrange(n)
            links[a].add(b)
            links[b].add(a)
        roots, want = cluster(n, lambda i: links[i]), list(range(n))
        for _ in range(n):
            for a in range(n):
                for b in links[a]:
                    want[a] = want[b] = min(want[a], want[b])
        assert roots == want


# -- 7: mixing ----------------------------------------------------------------

def brute_targets(sizes, passes=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        share = sum(weight[s] for s in free)
        rest = total - sum(fixed.values())
        goal = {s: rest * weight[s] / share for s in free}
        over = [s for s in free if goal[s] > passes * sizes[s] + 1e-9]
        if not over:
            return {**fixed, **goal}
        fixed.update({s: passes * sizes[s] for s in over})


def test_mixing_meets_targets(spark):
    r = random.Random(8)
    texts = [prose(i, r.choice([0, 1, 10, 300, 2000])) for i in range(300)] + [None, "", prose(1, 30), prose(1, 30)]
    names = [None, "b", "B", "é", "hot", "tiny"]
    sources = [names[4] if r.random() < 0.5 else r.choice(names[:4]) for _ in texts]
    sources[5], texts[5] = "tiny", prose(5, 40)
    docs = documents(spark, texts, sources)
    rows = mixing.mix_documents(docs).collect()
    assert sorted(x.doc_id for x in rows) == list(range(len(texts)))
    size = {}
    for t, s in zip(texts, sources):
        size[s] = size.get(s, 0) + len((t or "").split())
    goal = brute_targets(size)
    taken = {}
    for x in rows:
        s = sources[x.doc_id]
        assert x.size == len((texts[x.doc_id] or "").split()) and x.source_size == size[s]
        assert abs(x.target - goal[s]) < 1e-6 * max(1, goal[s]) and x.taken <= 3 * x.size
        taken[s] = taken.get(s, 0) + x.taken
    # One shard: what is left of it, less than a block for every source, is drawn.
    assert all(abs(taken[s] - goal[s]) <= len(goal) * mixing.BLOCK_WORDS for s in goal)
    assert {(x.doc_id, x.taken) for x in mixing.mix_documents(docs).collect()} == {(x.doc_id, x.taken) for x in rows}
    texts_out = {}
    for x in mixing.mixed_texts(docs).collect():
        assert x.n_chars == len(x.text)
        texts_out[x.doc_id] = texts_out.get(x.doc_id, 0) + len(x.text.split())
    assert texts_out == {x.doc_id: x.taken for x in rows if x.taken}
    assert mixing.mix_documents(docs.limit(0)).count() == 0


# -- 9: urls ------------------------------------------------------------------

def brute_address(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def test_urls(spark):
    urls = [None, "", "no scheme/en/", "http://Example.COM/en/x", "https://www.example.com/en/?q=a://b", "http://a.net/es/1", "http://net/fr/",
            "http://notnet/fr/", "x://h.com", "http://h.com?x", "http://h.com/#a", "http://www.example.com/de/", "a://b://c/d", "http://É.org/a\nb"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, bad boolean")
    got = {r.page_id: r for r in url_templates.judge(pages).collect()}
    for i, u in enumerate(urls):
        host, path = brute_address(u)
        best = max(((len(h + p), v, h + p) for v, h, p in url_templates.RULES
                    if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
        assert (got[i].host, got[i].path) == (host, path)
        assert got[i].rule == (best[2] if best else None) and got[i].verdict == (best[1] if best else "allow")
    assert url_templates.judge(pages.limit(0)).count() == 0


def test_templates_follow_the_labels(spark):
    rows, i = [], 0
    for k in range(120):
        for part, bad in (("news", False), ("spam", True), ("blog", False)):
            rows.append((i, f"http://h.org/{part}/{k}/page", bad if k % 2 else None))
            i += 1
    rows += [(i, "http://h.org/spam/900/page", None), (i + 1, "http://h.org/spam/900/page", None), (i + 2, "http://h.org/" + "a/" * 40, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    got = {r.page_id: r for r in url_templates.judge(pages, rules=()[:0] or (("allow", "none", "/"),)).collect()}
    assert len(got) == len(rows)
    assert got[i].verdict == got[i + 1].verdict == "block" and got[i].template == "/spam/*/*"
    assert {got[j].verdict for j in range(0, 360, 3)} == {"allow"} and got[i + 2].template == "/*" * 41


# -- 10: sharding -------------------------------------------------------------

def test_sharding(spark, tmp_path):
    texts = [prose(i, 20 + i % 50) for i in range(2000)] + ODD
    docs = documents(spark, texts)
    rows = sharding.shard_documents(docs).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    loads, places = {}, {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert r.size == len(raw) + 16 and r.text_crc32 == binascii.crc32(raw) and r.grown_shard is None and r.law == "bytes"
        loads[r.shard] = loads.get(r.shard, 0) + r.size
        places.setdefault(r.shard, []).append(r.slot)
    assert set(loads) == set(range(40))
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    largest = max(r.size for r in rows)
    assert max(loads.values()) - min(loads.values()) <= largest

    narrow = sharding.records(docs)
    sizes = sharding.slot_sizes(narrow)
    one = sharding.first_map(sizes, 40)
    path = str(tmp_path / "map")
    sharding.write_map(one, path)
    two = sharding.rebalance(sharding.read_map(spark, path, 1), sizes, 41)
    sharding.write_map(two, path)
    newest = {r.virtual_slot: r for r in sharding.read_map(spark, path).collect()}
    before = {r.virtual_slot: r.shard for r in sharding.read_map(spark, path, 1).collect()}
    assert len(newest) == len(before) == sharding.SLOTS and {r.version for r in newest.values()} == {2}
    weight = {r.virtual_slot: r.bytes for r in sizes.collect()}
    load = [0] * 41
    for s, r in newest.items():
        load[r.shard] += weight[s]
    moved = sum(weight[s] for s in before if before[s] != newest[s].shard)
    assert max(load) <= sum(load) / 41 * 1.02 + largest and moved <= 2 * sum(load) / 41


def test_sharding_of_odd_rows(spark):
    docs = documents(spark, ["a", "a", "b", None, ""], ids=[1, 1, None, None, 2])
    rows = sharding.shard_documents(docs, shards=2).collect()
    assert len(rows) == 5 and sorted((r.shard, r.slot) for r in rows) == sorted(set((r.shard, r.slot) for r in rows))
    assert sharding.shard_documents(docs.limit(0)).count() == 0
