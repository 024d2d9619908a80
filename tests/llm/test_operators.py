"""Each operator against a plain version of itself, with odd rows."""

import bisect
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattika.llm import decontamination, embedding_dedup, language_id, near_dedup, piece_codec, sharding, suffix_automata, suffix_blocks, token_counts, training_order
from lattika.llm.common import table
from lattika.llm.components import components
from lattika.llm.registry import ORACLES, QUERIES

ODD = [None, "", " ", "a", "A1 b2", "é ü ", "日本語 テキスト", "x" * 3000, "the cat sat on the mat " * 400, "\x00\t\r\n", "<|endoftext|> <s> ▁ a", "🙂 b"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, first long, score double, items string, c0 int, __found int"


def docs_of(spark, texts, ids=None, lang="en"):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, lang, "s", 0, "k", 1, 0.5, "i", 7, 8) for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(3)


def passages(seed, n, words):
    """Texts that share passages, with copies."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    shared = [" ".join(rng.choice(vocabulary) for _ in range(words)) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.4 else " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 2 * words))) for _ in range(rng.randint(1, 4))]
        out.append(rng.choice([" ", "\n", "  "]).join(parts))
    return out + out[: n // 4] + ODD


def covered(seqs, window):
    """Places of each sequence in a window that an earlier one holds."""
    first = {}
    for d, s in seqs:
        for k in range(len(s) - window + 1):
            w = tuple(s[k : k + window])
            first[w] = min(first.get(w, d), d)
    out = []
    for d, s in seqs:
        hit = np.zeros(len(s), bool)
        for k in range(len(s) - window + 1):
            if first[tuple(s[k : k + window])] < d:
                hit[k : k + window] = True
        out.append(hit)
    return out


def as_tables(tmp_path, **frames):
    for name, df in frames.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_registry():
    assert [int(re.match(r"op(\d+)_", q)[1]) for q in sorted(QUERIES, key=lambda q: int(re.match(r"op(\d+)_", q)[1]))] == list(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)


def test_decontamination(spark, tmp_path):
    texts = passages(1, 30, 12)
    items = [(1, texts[0]), (2, "  "), (3, None), (4, texts[1].upper()), (5, "sat on THE"), (5, "sat on the mat, the")]
    items = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.op1_decontamination(spark, as_tables(tmp_path, documents=docs_of(spark, texts), benchmark=items)).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    wins = [(str(r.item_id), tuple(w[k : k + 10])) for r in items.collect() for w in [word.findall((r.text or "").translate(low))] if w for k in range(max(1, len(w) - 9))]
    for d, t in enumerate(texts):
        w, hit, found = word.findall((t or "").translate(low)), set(), set()
        for name, s in wins:
            for k in range(len(w) - len(s) + 1):
                if tuple(w[k : k + len(s)]) == s:
                    hit |= set(range(k, k + len(s)))
                    found.add(name)
        assert (got[d].n_words, got[d].n_hit, got[d].n_items, got[d].contaminated) == (len(w), len(hit), len(found), bool(hit))
        assert got[d].items_sha256 == sha(",".join(sorted(found)).encode())
    assert decontamination.find_contamination(docs_of(spark, ["one two"]), items.limit(0)).first().n_hit == 0


def test_decontamination_in_passes_and_spans(spark, monkeypatch):
    texts = ["x " + "w%d " % i * 10 + "y" for i in range(8)]
    items = spark.createDataFrame([(i, "w%d " % i * 10) for i in range(8)], "item_id long, text string")
    monkeypatch.setattr(decontamination, "AUTOMATON_BYTES", 6)
    rows = decontamination.find_contamination(docs_of(spark, texts), items).collect()
    assert len(rows) == 8 and all(r.n_hit == 10 and r["items"] == [str(r.doc_id)] for r in rows)
    assert all(texts[r.doc_id][s.start : s.end] == ("w%d " % r.doc_id * 10).strip() for r in rows for s in r.spans)
    assert decontamination.drop_contaminated(docs_of(spark, texts), items.filter("item_id < 3")).count() == 5


def test_many_items_pass_a_filter(spark, tmp_path, monkeypatch):
    texts = passages(32, 30, 12)
    items = [(i, t) for i, t in enumerate(texts[:4])] + [(100 + i, " ".join(f"u{i}w{k}" for k in range(40))) for i in range(200)] + [(900, "sat on the"), (901, None), (None, texts[5])]
    items = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(spark, texts)
    whole = {r.doc_id: r.asDict() for r in decontamination.find_contamination(docs, items).collect()}
    monkeypatch.setattr(decontamination, "AUTOMATON_BYTES", 3000)
    windows = decontamination.item_windows(items, "item_id", "text", 10)
    left = decontamination.occurring(windows, docs, "text", 10)
    assert left.filter("name >= '100' and name < '300'").count() < 100 < windows.filter("name >= '100' and name < '300'").count()
    assert {r.doc_id: r.asDict() for r in decontamination.find_contamination(docs, items).collect()} == whole
    assert any(r["n_hit"] for r in whole.values())


def test_short_items_leave_clean_documents(spark, monkeypatch):
    nine, long = "i j k l m n o p q", "a b c d e f g h i j k l"
    items = spark.createDataFrame([(1, "Yes"), (2, "the capital"), (3, nine), (4, long)], "item_id long, text string")
    texts = ["well yes, it is so", "this is the capital of it, yes", "yes", "yes yes, no", "The capital!", f"x y {nine} z", f"x {long[:19]} y", f"x {long[:17]} y", None, "yes the capital w x y z"]
    want = [0, 1, 7, 8, 9]
    for size in (decontamination.AUTOMATON_BYTES, 12):
        monkeypatch.setattr(decontamination, "AUTOMATON_BYTES", size)
        assert sorted(r.doc_id for r in decontamination.drop_contaminated(docs_of(spark, texts), items).collect()) == want
    # the operator still reports each hit
    assert [r.n_hit for r in decontamination.find_contamination(docs_of(spark, texts), items).orderBy("doc_id").collect()] == [1, 3, 1, 2, 2, 9, 10, 0, 0, 3]


def test_sentencepiece(spark, tmp_path):
    import sentencepiece

    texts = passages(2, 30, 12)
    library = sentencepiece.SentencePieceProcessor(model_file=piece_codec.model_file())
    got = {r.doc_id: r for r in piece_codec.op2_sentencepiece(spark, as_tables(tmp_path, documents=docs_of(spark, texts))).collect()}
    for d, t in enumerate(texts):
        ids = [1, *library.encode(t or ""), 2]
        assert (got[d].n_tokens, got[d].ids_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()))
        assert got[d].decoded_sha256 == sha(library.decode(ids).encode())
    rows = piece_codec.encode_documents(docs_of(spark, texts), piece_codec.model_file())
    assert piece_codec.decode_ids(rows, piece_codec.model_file()).filter("text <> decoded").count() == 0
    assert rows.limit(0).count() == 0


def test_token_counts(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = passages(3, 30, 12) + ["it's we'll 'tis x'd''s", "a  b   c\n\n d\t", "x<|endoftext|>y z<|endoftext|>"]
    library = Tokenizer.from_file(token_counts.vocabulary_file())
    got = {r.doc_id: r for r in token_counts.op3_token_counts(spark, as_tables(tmp_path, documents=docs_of(spark, texts))).collect()}
    for d, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[d].n_bytes, got[d].n_tokens, got[d].over_limit) == (len((t or "").encode()), n, n > 512)


def test_substring_dedup(spark, tmp_path):
    texts = passages(4, 60, 20)
    got = {r.doc_id: r for r in suffix_automata.op4_substring_dedup(spark, as_tables(tmp_path, documents=docs_of(spark, texts))).collect()}
    seqs = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in enumerate(texts)]
    for (d, s), hit in zip(seqs, covered(seqs, 13), strict=True):
        kept = " ".join(w for w, h in zip(s, hit, strict=True) if not h)
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (len(s), int(hit.sum()), sha(kept.encode()))


def brute_windows(rows, docs, window):
    least = {}
    for row, d in zip(rows, docs, strict=True):
        for k in range(len(row) - window + 1):
            w = bytes(row[k : k + window])
            least[w] = min(least.get(w, d), d)
    return [least[bytes(row[k : k + window])] for row in rows for k in range(len(row) - window + 1)]


@pytest.mark.parametrize("bucket", [1, 40, 10**6])
def test_cover_sort_and_automata_against_brute_force(monkeypatch, bucket):
    from lattika.llm.repeats import Shape

    monkeypatch.setattr(suffix_blocks, "BUCKET", bucket)
    monkeypatch.setattr(suffix_automata, "SHARD_WORDS", bucket)
    rng = random.Random(28)
    for window in (9, 16, 50):
        base = [rng.randint(97, 98) for _ in range(40)] * 3 + [rng.randint(97, 122) for _ in range(80)]
        rows = []
        for _ in range(60):
            a = rng.randint(0, len(base) - window - 20)
            row = base[a : a + window + rng.randint(0, 20)]
            if rng.random() < 0.5:
                row[rng.randrange(len(row))] = 120
            rows.append(row)
        docs = np.array([rng.randint(0, 30) for _ in rows])
        offsets = np.r_[0, np.cumsum([len(r) for r in rows])]
        flat = np.concatenate([np.array(r, np.uint8) for r in rows])
        want = brute_windows(rows, docs.tolist(), window)
        shape = Shape(window, 4, "u1", 2)
        assert suffix_blocks.smallest_documents(shape, flat, offsets, docs, np.zeros(len(rows), np.uint64)).tolist() == want
        shape = Shape(window, 4, "<u8", 2)
        assert suffix_automata.smallest_documents(shape, flat.astype(np.uint64), offsets, docs, np.zeros(len(rows), np.uint64)).tolist() == want


def test_cover_sort_orders_suffixes():
    rng = random.Random(29)
    text = bytes(rng.choice(b"ab") for _ in range(500)) * 2 + bytes(rng.choice(b"abc") for _ in range(700))
    sorter = suffix_blocks.CoverSorter(np.frombuffer(text, np.uint8), 50)
    at = np.array(rng.sample(range(len(text) - 60), 900))
    ordered = at[sorter.order(at)]
    cut = [text[p : p + 50] for p in ordered]
    assert cut == sorted(cut) and sorter.opens(ordered).tolist() == [k == 0 or cut[k] != cut[k - 1] for k in range(len(cut))]


@pytest.mark.parametrize("bucket", [262_144, 50])
def test_suffixes_are_sorted_in_bounded_blocks(monkeypatch, bucket):
    rng = random.Random(37)
    deals = [bytes(rng.choice(b"ab") for _ in range(120)) for _ in range(40)]
    rows = []
    for deal, text in enumerate(deals):
        for _ in range(30 if deal == 7 else 4):
            a = rng.randint(0, 20)
            rows.append((text[a : a + rng.randint(50, 90)] + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 9))), rng.randint(0, 99), deal))
    rng.shuffle(rows)
    sizes = []
    sort = suffix_blocks.CoverSorter

    def sorter(text, depth):
        sizes.append(len(text))
        return sort(text, depth)

    monkeypatch.setattr(suffix_blocks, "BLOCK", 1000, raising=False)
    monkeypatch.setattr(suffix_blocks, "BUCKET", bucket)
    monkeypatch.setattr(suffix_blocks, "CoverSorter", sorter)
    symbols = np.frombuffer(b"".join(t for t, _, _ in rows), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t) for t, _, _ in rows])]
    got = suffix_blocks.smallest_documents(suffix_blocks.SHAPE, symbols, offsets, np.array([d for _, d, _ in rows]), np.array([x for _, _, x in rows], np.uint64))
    least = {}
    windows = [(x, t[k : k + 50], d) for t, d, x in rows for k in range(len(t) - 49)]
    for x, w, d in windows:
        least[x, w] = min(d, least.get((x, w), d))
    assert got.tolist() == [least[x, w] for x, w, _ in windows]
    # no block is longer than BLOCK and the passages of a hash, of which one has more than BLOCK
    most = {}
    for t, _, x in rows:
        most[x] = most.get(x, 0) + len(t)
    assert sum(sizes) == len(symbols) and max(sizes) <= 1000 + max(most.values()) and len(sizes) > 5


@pytest.mark.parametrize("bits", [10, 62])
def test_keys_are_sorted_with_their_numbers(bits):
    rng = random.Random(41)
    key = np.array([rng.randrange(2**bits) for _ in range(300)] * 2)
    value, order = suffix_blocks.sort_with(key, bits)
    assert value.tolist() == sorted(key.tolist()) == key[order].tolist() and sorted(order.tolist()) == list(range(600))


@pytest.mark.parametrize("hot", [64, 1])
def test_repeats_with_split_anchors_and_small_segments(spark, tmp_path, monkeypatch, hot):
    from lattika.llm import repeats

    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "PACK_BYTES", 2000)
    monkeypatch.setattr(repeats, "SEGMENT", 300)
    texts = passages(30, 40, 25)
    sf = as_tables(tmp_path, documents=docs_of(spark, texts))
    for query, seqs, window, sep in (
        (suffix_automata.op4_substring_dedup, [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in enumerate(texts)], 13, " "),
        (suffix_blocks.op6_suffix_dedup, [(d, (t or "").encode()) for d, t in enumerate(texts)], 50, b""),
    ):
        got = {r.doc_id: r for r in query(spark, sf).collect()}
        for (d, s), hit in zip(seqs, covered(seqs, window), strict=True):
            kept = [x for x, h in zip(s, hit, strict=True) if not h]
            assert (got[d].n_removed, got[d].kept_sha256) == (int(hit.sum()), sha(bytes(kept) if sep == b"" else sep.join(kept).encode()))


def test_words_are_dropped(spark):
    texts = passages(31, 30, 20)
    docs = docs_of(spark, texts)
    left = suffix_automata.drop_repeated_words(docs)
    assert left.columns == docs.columns
    seqs = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in enumerate(texts)]
    hits = covered(seqs, 13)
    for r in left.collect():
        hit = hits[r.doc_id]
        want = " ".join(w for w, h in zip(seqs[r.doc_id][1], hit, strict=True) if not h) if hit.any() else texts[r.doc_id]
        assert r.text == want


def test_automaton_matches_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        seqs = [[rng.randint(0, 2) for _ in range(rng.randint(0, 12))] for _ in range(rng.randint(1, 5))]
        automaton = suffix_automata.SuffixAutomaton()
        for d, s in enumerate(seqs):
            automaton.add(s, d)
        automaton.finish()
        text = [rng.randint(0, 3) for _ in range(20)]
        for n in (1, 2, 4):
            want = [min((d for d, s in enumerate(seqs) if k + 1 >= n and any(s[j : j + n] == text[k + 1 - n : k + 1] for j in range(len(s) - n + 1))), default=suffix_automata.FAR_DOC) for k in range(20)]
            assert automaton.matches(text, n) == want


def test_reference_is_removed(spark):
    reference = spark.createDataFrame([("p q r s t u v w x y z a b c d",), (None,)], "text string")
    rows = suffix_automata.remove_reference(docs_of(spark, ["k q r s t u v w x y z a b c l", "q r", None]), reference)
    assert {r.doc_id: r.text for r in rows.collect()} == {0: "k l", 1: "q r", 2: None}


def test_language_id(spark, tmp_path):
    rng = random.Random(6)
    alphabets = {"aa": "abcde", "bb": "defgh", "cc": "жзикл"}
    rows = [(i, " ".join("".join(rng.choice(alphabets[x]) for _ in range(rng.randint(2, 7))) for _ in range(30)), x, "s", 0, "k", 1, 0.5, "i", 7, 8) for i in range(240) for x in [list(alphabets)[i % 3]]]
    rows += [(300 + i, t, "aa", "s", 0, "k", 1, 0.5, "i", 7, 8) for i, t in enumerate([None, "", "1234 !!", "q"])]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in language_id.op5_language_id(spark, as_tables(tmp_path, documents=docs)).collect()}
    assert all(got[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in rows)
    assert np.mean([got[r[0]].lang_pred == r[2] for r in rows[:240]]) == 1
    assert [got[300 + i].lang_pred for i in range(3)] == ["und"] * 3 and got[303].lang_pred in alphabets
    assert all(0 <= r.score <= 1 for r in got.values())
    filters = language_id.learn(docs)
    kept = language_id.drop_foreign(docs, filters)
    assert kept.columns == docs.columns and kept.count() == 241
    assert {r.lang_pred for r in language_id.identify(docs, language_id.learn(docs.limit(0))).collect()} == {"und"}


def test_language_of_few_documents(spark):
    rng = random.Random(17)
    said = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))
    rows = [(i, said("abcde", 30), "aa") for i in range(60)] + [(100, said("жзиклмнопрст", 30), "cc"), (101, said("жзиклмнопрст", 30), None), (102, said("uvwxyz", 30), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language_id.learn(docs)
    got = {r.doc_id: r for r in language_id.identify(docs, filters).collect()}
    assert got[100].lang_pred == "cc" and got[100].score > 0.9
    # the foreign text goes, the labelled and the unlabelled one of the language of one document stay
    assert sorted(r.doc_id for r in language_id.drop_foreign(docs, filters).collect()) == [*range(60), 100, 101]
    assert filters.thin == ("cc",)


def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = language_id.op5_language_id(spark, sf).join(table(spark, sf, "documents"), "doc_id").filter("held_out")
    assert rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_suffix_dedup(spark, tmp_path):
    texts = passages(7, 40, 20)
    got = {r.doc_id: r for r in suffix_blocks.op6_suffix_dedup(spark, as_tables(tmp_path, documents=docs_of(spark, texts))).collect()}
    seqs = [(d, (t or "").encode()) for d, t in enumerate(texts)]
    for (d, s), hit in zip(seqs, covered(seqs, 50), strict=True):
        runs = int((np.diff(np.r_[0, hit.astype(int)]) == 1).sum())
        kept = bytes(b for b, h in zip(s, hit, strict=True) if not h)
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(s), int(hit.sum()), runs, sha(kept))
    docs = docs_of(spark, texts)
    left = suffix_blocks.drop_repeats(docs)
    assert left.columns == docs.columns and left.count() == len(texts)
    for r in left.collect():
        assert (r.text is None) == (texts[r.doc_id] is None) and got[r.doc_id].n_bytes - got[r.doc_id].n_removed >= len((r.text or "").encode())
    assert suffix_blocks.drop_repeats(docs.limit(0)).count() == 0


def grouped(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_near_dedup(spark, tmp_path):
    rng = random.Random(8)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(80)] for _ in range(12)]
    texts = [" ".join(b) for b in base]
    for b in base[:8]:
        for edits in (1, 1, 2, 3, 4):
            c = list(b)
            for _ in range(edits):
                c[rng.randrange(80)] = "Z" + rng.choice("abc")
            texts.append(" ".join(c))
    texts += [texts[0], texts[3], *ODD]
    got = {r.doc_id: r for r in near_dedup.op7_minhash_dedup(spark, as_tables(tmp_path, documents=docs_of(spark, texts))).collect()}
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    links = [(a, b) for a in range(len(texts)) for b in range(a) if texts[a] is not None and (texts[a] == texts[b] or (sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])))]
    assert [got[d].group_id for d in range(len(texts))] == grouped(len(texts), links)
    assert all(r.kept == (r.group_id == d) for d, r in got.items())
    docs = docs_of(spark, texts)
    kept = near_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d, r in got.items() if r.kept)
    assert near_dedup.keep_one_of_each(docs.limit(0)).count() == 0


def test_near_dedup_of_other_repeat_counts(spark):
    rng = random.Random(15)
    say = lambda n: [rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(n)]
    texts = []
    for more in (10, 20, 50, 50, 50, 50, 50, 200):
        head, line, tail = say(94), say(12), say(94)
        texts += [" ".join(head + line * n + tail) for n in (1, 1 + more)]
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs_of(spark, texts)).collect()}
    assert [got[d].group_id for d in range(len(texts))] == [d - d % 2 for d in range(len(texts))]
    assert sum(r.kept for r in got.values()) == len(texts) // 2


@pytest.mark.parametrize("share", [1, 10**9])
def test_near_dedup_by_small_chunks(spark, monkeypatch, share):
    rng = random.Random(16)
    monkeypatch.setattr(near_dedup, "SHARE", share)
    monkeypatch.setattr(near_dedup, "CHUNK", 3)
    monkeypatch.setattr(near_dedup, "CHUNK_SHINGLES", 150)
    texts, base = [], [rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(80)]
    for _ in range(40):
        c = list(base)
        for _ in range(rng.randint(0, 3)):
            c[rng.randrange(80)] = "Z" + rng.choice("abc")
        texts.append(" ".join(c))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    links = [(a, b) for a in range(40) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.group_id for r in near_dedup.near_duplicates(docs_of(spark, texts)).collect()}
    assert [got[d] for d in range(40)] == grouped(40, links)


def test_near_dedup_of_a_doc_id_with_several_texts(spark):
    rng = random.Random(16)
    a, b, c = (" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(80)) for _ in range(3))
    rows = [(3, a), (5, a + " more"), (5, b), (5, b), (5, c), (5, c + " more"), (6, c), (7, "z"), (None, "z"), (8, None)]
    kept = near_dedup.keep_one_of_each(docs_of(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    near_c = [(r.doc_id, r.text) for r in kept if (r.text or "").startswith(c)]
    assert len(near_c) == 1 and near_c[0] in [(5, c), (5, c + " more")]
    assert sorted(((r.doc_id, r.text) for r in kept if not (r.text or "").startswith(c)), key=str) == sorted([(3, a), (5, b), (7, "z"), (None, "z"), (8, None)], key=str)


def test_probability_jaccard():
    a, b = {1: 3.0, 2: 1.0, 3: 2.0}, {1: 1.0, 2: 2.0, 4: 1.0}
    rows = [(h, w, d) for d, x in enumerate((a, b)) for h, w in x.items()]
    element, weight, owner = (np.array(x) for x in zip(*rows, strict=True))
    sign = near_dedup.signatures(near_dedup.mix64(element.astype(np.uint64)), weight, owner, 2, 8000)
    want = sum(1 / sum(max(a.get(y, 0) / a[x], b.get(y, 0) / b[x]) for y in {*a, *b}) for x in {*a} & {*b})
    assert abs((sign[0] == sign[1]).mean() - want) < 0.03


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_sharding(spark, shards):
    texts = passages(9, 40, 8) + [None]
    ids = [None, *range(1, len(texts) - 1), 5]
    rows = sharding.shard_documents(docs_of(spark, texts, ids), shards).collect()
    assert len(rows) == len(texts) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    groups = {}
    for i, t in zip(ids, texts, strict=True):
        g = groups.setdefault(t, [None, 0, True])
        g[0] = min((x for x in (g[0], i) if x is not None), default=None)
        g[1] += len((t or "").encode()) + 1
    sizes = [g[1] for g in sorted(groups.values(), key=lambda g: (g[0] is not None, g[0] or 0))]
    held = [sum(r.size for r in rows if r.shard == s) for s in range(shards)]

    def needed(capacity):
        n, room = 1, capacity
        for x in sizes:
            if x > room:
                n, room = n + 1, capacity
            room -= x
        return n

    best = bisect.bisect_left(range(max(sizes), sum(sizes) + 1), True, key=lambda c: needed(c) <= shards) + max(sizes)
    assert max(held) == best
    crc = {(r.size, r.text_crc32) for r in rows}
    assert crc == {(len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts}


def test_sharding_of_nothing(spark):
    assert sharding.shard_documents(docs_of(spark, ["a"]).limit(0)).count() == 0


def test_permutation():
    for n in (1, 2, 5, 1000, 4097):
        p = training_order.Permutation(n, 7)
        slots = p.slot(np.arange(n))
        assert sorted(slots) == list(range(n)) and (p.number(slots) == np.arange(n)).all()
    assert (training_order.Permutation(1000, 7).slot(np.arange(1000)) != training_order.Permutation(1000, 8).slot(np.arange(1000))).any()


def in_order(texts, ids):
    """The library's tokens of all texts by doc_id, each closed."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.vocabulary_file())
    rows = sorted(zip(ids, texts, strict=True), key=lambda r: (r[0] is not None, r[0] or 0))
    return [i for _, t in rows for i in [*library.encode(t or "", add_special_tokens=False).ids, 50256]]


def test_training_order(spark, tmp_path):
    texts = passages(10, 20, 10)
    file = token_counts.vocabulary_file()
    want = np.array(in_order(texts, range(len(texts))))
    ordered = training_order.training_order(docs_of(spark, texts), file, length=32, shard_rows=16)
    rows = {r.slot: r for r in ordered.collect()}
    total = -(-len(want) // 32)
    assert sorted(rows) == list(range(total)) and {r.sequence for r in rows.values()} == set(range(total))
    order = training_order.Permutation(total, training_order.KEY)
    for s, r in rows.items():
        assert (r.shard, r.byte_offset, len(r.record)) == (s // 16, s % 16 * 66, 64) and order.slot(np.array([r.sequence]))[0] == s
        assert sum(d.n for d in r.docs) == r.n_tokens and [d["at"] for d in r.docs] == np.r_[0, np.cumsum([d.n for d in r.docs])][:-1].tolist()
    stream = np.concatenate([np.frombuffer(r.record, "<u2")[: r.n_tokens] for r in sorted(rows.values(), key=lambda r: r.sequence)])
    assert stream.tolist() == want.tolist()
    folder = str(tmp_path / "order")
    training_order.write_shards(docs_of(spark, texts), folder, file, length=32, shard_rows=16)
    back = {r.slot: r for r in training_order.read_shards(spark, folder).collect()}
    assert {s: (r.shard, r.byte_offset, r.record) for s, r in back.items()} == {s: (r.shard, r.byte_offset, r.record) for s, r in rows.items()}
    got = training_order.read_slots(spark, folder, 10, 30)
    assert got.tolist() == [np.frombuffer(rows[s].record, "<u2").tolist() for s in range(10, min(40, total))]
    assert training_order.read_slots(spark, folder, total, 5).shape == (0, 32)


def test_training_order_of_other_layouts(spark):
    texts = passages(22, 20, 10)
    ids = [None, 5, 5, 5, *range(10, 6 + len(texts))]
    docs = docs_of(spark, texts, ids)
    got = []
    for parts in (1, 4):
        rows = training_order.training_order(docs.repartition(parts, "text"), token_counts.vocabulary_file(), length=32, shard_rows=16).collect()
        got.append({r.slot: (r.sequence, r.record) for r in rows})
    assert got[0] == got[1]
    assert training_order.training_order(docs.limit(0), token_counts.vocabulary_file()).count() == 0


def test_query_of_training_order(spark, tmp_path):
    texts = passages(23, 30, 10)
    rows = training_order.op9_training_order(spark, as_tables(tmp_path, documents=docs_of(spark, texts))).collect()
    want = np.array(in_order(texts, range(len(texts))))
    order = training_order.Permutation(len(rows), training_order.KEY)
    stream = np.concatenate([np.frombuffer(r.record, "<u2") for r in sorted(rows, key=lambda r: order.number(np.array([r.slot]))[0])])
    assert stream[: len(want)].tolist() == want.tolist() and set(stream[len(want) :].tolist()) <= {50256}


def long_texts():
    rng = random.Random(24)
    words = ["".join(rng.choice("abcdefghij é日") for _ in range(rng.randint(1, 9))) for _ in range(500)]
    return [" ".join(rng.choice(words) for _ in range(3000)) + end for end in ("", " ", "\n\n  x", "'s <|endoftext|> y")] + ["ab1cd2" * 900 + "'s 've", "。" + "日本" * 2000 + "12", "x" * 5000, "", None, "a"]


def test_long_texts_are_cut_where_nothing_crosses(monkeypatch):
    import sentencepiece
    from tokenizers import Tokenizer

    texts = long_texts()
    for module, most in ((token_counts, 700), (piece_codec, 700), (language_id, 700)):
        monkeypatch.setattr(module, "SLICE", most)
    monkeypatch.setattr(piece_codec, "IDS", 100)
    byte, library = token_counts.ByteVocabulary(token_counts.vocabulary_file()), Tokenizer.from_file(token_counts.vocabulary_file())
    assert len(list(byte.cut(texts[0], 700))) > 10 and len(list(byte.cut(texts[4], 700))) > 3
    got = [[] for _ in texts]
    for k, _, ids, n in byte.encode_all(iter(texts)):
        got[k] += ids.tolist()
        assert len(ids) == n
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    piece, library = piece_codec.load_model(piece_codec.model_file()), sentencepiece.SentencePieceProcessor(model_file=piece_codec.model_file())
    assert len(list(piece.cut(texts[0], 700))) > 10
    for t, ids in zip(texts, piece.encode_all(iter(texts)), strict=True):
        want = [1, *library.encode(t or ""), 2]
        assert np.frombuffer(ids, "<u4").tolist() == want and piece.decode(np.frombuffer(ids, "<u4")) == library.decode(want)
    for t in texts:
        if t:
            assert np.concatenate(list(language_id.gram_parts(t))).tolist() == language_id.grams([t])[0].tolist()


def test_language_counts_against_brute_force(monkeypatch):
    rng = random.Random(25)
    learned = [["".join(rng.choice(a) for _ in range(4)) for _ in range(200)] for a in ("abcdef", "defghi", "jklmno")]
    grams = [np.unique(np.concatenate([language_id.grams([w])[0] for w in words])) for words in learned]
    filters = language_id.LanguageFilters.build(["x", "y", "z"], np.concatenate(grams), np.repeat(np.arange(3), [len(g) for g in grams]))
    texts = [" ".join(rng.choice(learned[k % 3] + learned[(k + 1) % 3]) for _ in range(60)) for k in range(30)] + [None, "", "12", "q"]
    sets = [set(g.tolist()) for g in grams]
    names, score, n = filters.predict(texts)
    for k, t in enumerate(texts):
        own = language_id.grams([t])[0].tolist()
        assert n[k] == len(own)
        if not any(c.isalpha() for c in t or ""):
            assert names[k] == "und" and score[k] == 0
            continue
        exact = [sum(g in s for g in own) / max(1, len(own)) for s in sets]
        # the masks hold every learned n-gram; what else they report is the corrected share of false positives
        assert names[k] == "xyz"[int(np.argmax(exact))] or max(exact) - exact["xyz".index(names[k])] < 0.05
        assert abs(score[k] - max(exact)) < 0.1
    whole = filters.predict(texts)
    monkeypatch.setattr(language_id, "SLICE", 50)
    parts = filters.predict(texts)
    assert parts[0] == whole[0] and np.allclose(parts[1], whole[1]) and (parts[2] == whole[2]).all()


def test_embedding_dedup(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(20, 16))
    vectors = [(centres[i % 20] + 0.08 * rng.normal(size=16)).astype(np.float32).tolist() for i in range(300)]
    vectors += [vectors[0], vectors[1], None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    rows = [(i, v, None if i % 50 == 49 else i % 20 % 3, "x") for i, v in enumerate(vectors)]
    got = {r.vec_id: r for r in embedding_dedup.embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string")).collect()}

    def sound(v):
        return bool(v) and None not in v and np.isfinite(v).all() and np.any(v)

    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if sound(v) else None for v in vectors]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and rows[a][2] is not None and rows[a][2] == rows[b][2] and unit[a] @ unit[b] >= 0.98]
    assert [got[i].component_id for i in range(len(rows))] == grouped(len(rows), links)
    count = np.bincount([x for pair in links for x in pair], minlength=len(rows))
    assert [got[i].n_links for i in range(len(rows))] == count.tolist()
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def pairs_of(blocks):
    return {(a + q, n) for a, hit in blocks for q, n in zip(*(x.tolist() for x in np.nonzero(hit)), strict=True)}


def exact(vectors, queries, least=0.98 - embedding_dedup.SLACK):
    return pairs_of(embedding_dedup.exact_blocks(vectors, queries, least))


def test_graph_recall():
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(300, 24))
    v = np.repeat(centres, 10, axis=0) + 0.05 * rng.normal(size=(3000, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = embedding_dedup.Graph(v, np.arange(3000))
    found, audit = embedding_dedup.audited_search(graph, graph.vectors, same=True)
    itself = {(k, k) for k in range(3000)}
    want, got = exact(graph.vectors, graph.vectors) - itself, pairs_of(found) - itself
    assert got <= want and len(got) >= 0.98 * len(want) and audit["recall"] >= embedding_dedup.RECALL and audit["audited"] >= embedding_dedup.AUDITED and not audit["exact"]


def unit_rows(seed, n):
    v = np.random.default_rng(seed).normal(size=(n, 24))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_audit_sees_rare_links(monkeypatch):
    v, other = unit_rows(18, 1000), unit_rows(19, 1000)
    other[[101, 557]] = v[[3, 700]]
    graph = embedding_dedup.Graph(v, np.arange(1000))
    monkeypatch.setattr(embedding_dedup.Graph, "blocks", lambda self, queries, *a: [(0, np.zeros((len(queries), 1000), bool))])
    assert pairs_of(embedding_dedup.audited_search(graph, other.astype(np.float32))[0]) == {(101, 3), (557, 700)}


def test_audit_counts_no_hit_on_itself(monkeypatch):
    v = unit_rows(27, 4000)
    v[2000:2020] = v[:20]
    graph = embedding_dedup.Graph(v, np.arange(4000))
    monkeypatch.setattr(embedding_dedup.Graph, "blocks", lambda self, queries, *a: [(0, queries @ self.vectors.T > 0.9999)] if len(queries) < 4000 else [(0, np.eye(4000, dtype=bool))])
    found, audit = embedding_dedup.audited_search(graph, graph.vectors, same=True)
    assert audit["audited"] == 40 and len(pairs_of(found)) == 4040


def test_every_node_of_a_graph_is_reached_beside_many_near_copies():
    rng = np.random.default_rng(35)
    v = rng.normal(size=(5000, 64))
    v[::9] = v[0] + 0.12 * rng.normal(size=(556, 64))
    v[0] = rng.normal(size=64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = embedding_dedup.Graph(v, np.arange(5000))
    seen, new = {graph.entry}, {graph.entry}
    while new:
        new = set(graph.layers[0][list(new)].ravel().tolist()) - seen - {-1}
        seen |= new
    assert len(seen) == 5000
    lost = 0
    for (a, hit), (_, want) in zip(graph.blocks(graph.vectors, embedding_dedup.BEAM, 0.9799), embedding_dedup.exact_blocks(graph.vectors, graph.vectors, 0.9799), strict=True):
        lost += int((want & ~hit).sum())
    assert lost < 50


def test_beams_are_not_widened_beyond_the_cost_of_a_full_search(monkeypatch):
    v = unit_rows(33, 8000)
    v[4000:] = v[:4000]
    graph = embedding_dedup.Graph(v, np.arange(8000))
    widths = []

    def nothing(self, queries, width, least):
        widths.append(width)
        yield 0, np.zeros((len(queries), 8000), bool)

    monkeypatch.setattr(embedding_dedup.Graph, "blocks", nothing)
    found, audit = embedding_dedup.audited_search(graph, graph.vectors, same=True)
    assert widths == [48, 96, 192] and audit["exact"] and pairs_of(found) == exact(graph.vectors, graph.vectors)


def test_audit_keeps_small_groups_beside_a_hot_one(monkeypatch):
    v = unit_rows(20, 8000)
    v[:120] = v[0]
    v[1001:8000:2] = v[1000:8000:2]
    graph = embedding_dedup.Graph(v, np.arange(8000))

    def hot_only(self, queries, width, least):
        for a, hit in embedding_dedup.exact_blocks(self.vectors, queries, least):
            hit[:, 120:] = False
            yield a, hit

    monkeypatch.setattr(embedding_dedup.Graph, "blocks", hot_only)
    found, _ = embedding_dedup.audited_search(graph, graph.vectors, same=True)
    assert sum(int(hit.sum()) for _, hit in found) == 120 * 120 + 880 + 3500 * 4


def test_shards_are_searched_both_ways(monkeypatch):
    shards = []
    for k in range(2):
        v = unit_rows(21, 300)
        shards.append((np.arange(300) + 300 * k, np.ones(300, np.int64), v, embedding_dedup.Graph(v, np.arange(300))))

    def half(graph, queries, same=False):
        calls.append(1)
        hit = queries @ graph.vectors.T >= 0.98
        hit[:, :150] &= len(calls) == 1
        hit[:, 150:] &= len(calls) == 2
        return [(0, hit)], {"width": 1, "recall": 1.0, "audited": 1, "exact": False}

    calls = []
    monkeypatch.setattr(embedding_dedup, "audited_search", half)
    node, links, root, audits = embedding_dedup.search_pair(*shards)
    assert sorted(node) == list(range(600)) and set(links) == {1} and len(set(root)) == 300 and len(audits) == 2


def test_embedding_dedup_of_several_shards(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD", 60)
    monkeypatch.setattr(embedding_dedup, "STEP", 16)
    rng = np.random.default_rng(26)
    centres = rng.normal(size=(40, 16))
    vectors = [(centres[i % 40] + 0.08 * rng.normal(size=16)).tolist() for i in range(500)]
    vectors += [(centres[0] + 0.001 * rng.normal(size=16)).tolist() for _ in range(100)]
    rows = [(i, v, "odd" if i % 40 % 2 else "even") for i, v in enumerate(vectors)]
    out = embedding_dedup.embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"))
    got = {r.vec_id: r for r in out.collect()}
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows]))
    np.fill_diagonal(near, False)
    assert [got[i].n_links for i in range(600)] == near.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(600)] == grouped(600, np.argwhere(near).tolist())
    audits = out.audits.collect()
    assert len(audits) == 30 and all(r.recall >= embedding_dedup.RECALL for r in audits)


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 4), (20, 21), (7, 7)]
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 10: 1, 11: 1, 20: 20, 21: 20}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark, tmp_path):
    import sentencepiece

    import corpus_pipeline

    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, item = say(60), say(14)
    texts = [say(60) for _ in range(30)] + [say(30) + " " + passage + " " + say(30) for _ in range(4)] + [say(20) + " " + item + " " + say(20)]
    texts += [texts[0], texts[1] + " more", None, "123 456"]
    docs = docs_of(spark, texts)
    sf = as_tables(tmp_path, documents=docs, benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    left = [d for d in range(35) if d != 34]  # without the contaminated one, copies, null and letterless
    assert sorted(got) == left
    seqs = [(d, texts[d].encode()) for d in [*left, 34]]
    hits = {d: h for (d, _), h in zip(sorted(seqs), covered(sorted(seqs), 50), strict=True)}
    library = sentencepiece.SentencePieceProcessor(model_file=piece_codec.model_file())
    for d in left:
        text = bytes(b for b, h in zip(texts[d].encode(), hits[d], strict=True) if not h).decode()
        ids = [1, *library.encode(text), 2]
        assert (got[d].n_tokens, got[d].ids_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_link_groups_joins_what_any_pair_joins(monkeypatch):
    import pyarrow as pa

    rng = random.Random(14)
    monkeypatch.setattr(near_dedup, "CELLS", 200)
    for _ in range(30):
        sets = [np.unique(np.array([rng.randint(0, 30) for _ in range(rng.randint(1, 12))], np.uint64)) for _ in range(25)]
        group = [rng.choice([0, 0, 0, i]) for i in range(25)]
        out = near_dedup.link_groups((), pa.table({"node": list(range(25)), "component": group, "set": [x.tobytes() for x in sets]})).to_pydict()
        same = [(a, b) for a in range(25) for b in range(a) if group[a] == group[b]]
        near = [(a, b) for a in range(25) for b in range(a) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))]
        assert grouped(25, same + near) == grouped(25, same + list(zip(out["a"], out["b"], strict=True)))
