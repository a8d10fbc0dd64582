"""The text operators against brute force on small fixtures: nulls, empty and
long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import DATA
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vitalspan.llm import (
    components, fingerprints, html_text, language, line_templates, mixing, near_dedup, packing, quality_rules, queries, repeated_passages, shingles,
    url_filter,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, k long, t string, block int, component string"


@pytest.fixture(scope="module")
def make(spark):
    """Documents with extra columns whose names the operators use themselves."""
    def build(rows):
        full = [(i, t, lang, source, len(t or ""), -1, -2, "x", -3, "y") for i, t, lang, source in rows]
        return spark.createDataFrame(full, DOCS)
    return build


@pytest.fixture(scope="module")
def corpus():
    """Random documents with copies, near copies, shared passages, nulls,
    empty and blank texts, one long text and one repeated row."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgé", k=rng.randint(2, 7))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choices(vocabulary, k=n))

    passage = prose(50)
    rows = []
    for i in range(60):
        rows.append((i * 3, prose(rng.randint(1, 120)), rng.choice(["en", "fr"]), rng.choice(["a", "b", "c", None])))
    base = prose(200).split(" ")
    for i in range(12):
        words = list(base)
        for _ in range(i):
            words[rng.randrange(len(words))] = "edit" + str(rng.random())[2:6]
        rows.append((1000 + i, " ".join(words), "en", "a"))
    for i in range(6):
        rows.append((2000 + i, prose(20) + "\n" + passage + "  \t" + prose(20), "fr", "b"))
    rows += [(3000, None, None, None), (3001, "", "en", "a"), (3002, " \t\n", "fr", "b"), (3003, rows[0][1], "en", "c"),
             (3004, rows[0][1].upper(), "en", "c"), (3005, prose(6000), "en", "c"), (3006, "one two", "en", "b"), (3007, "ONE two", "en", "b"),
             (3008, ("again and " * 60).strip(), None, "b")]
    rows.append(rows[5])
    return rows


def words(text):
    return WORD.findall(text or "")


# -- 1 language


def test_language_labels_spans_and_texts(make):
    rng = random.Random(1)
    greek, latin, german = ["αβγ", "δεζη", "θικ"], ["lorem", "ipsum", "dolor"], ["straße", "über", "größe"]
    rows = []
    for i in range(120):
        lang, pool = [("el", greek), ("la", latin), ("de", german)][i % 3]
        rows.append((i, " ".join(rng.choices(pool, k=20)), lang, "s"))
    model = language.train(make([*rows, (900, None, "la", "s"), (901, "x", None, "s")]))
    assert model.languages == ("de", "el", "la")
    mixed = "lorem ipsum dolor ipsum lorem, αβγ δεζη θικ αβγ"
    tests = make([(1, "Lorem IPSUM", None, None), (2, "θικ!", None, None), (3, None, None, None), (4, "123 ...", None, None), (5, mixed, None, None), (5, mixed, None, None),
                  (6, "STRASSE über größe İ", None, None), (7, "", None, None)])
    got = sorted(language.identify(tests, model).collect(), key=lambda r: r["doc_id"])
    assert [r["lang_pred"] for r in got] == ["la", "el", "und", "und", "la", "la", "de", "und"]
    assert got[2]["score"] == 0 and got[2]["spans"] == []
    assert [(s["lang"], mixed[s["start"]:s["end"]]) for s in got[4]["spans"]] == [("la", "lorem ipsum dolor ipsum lorem"), ("el", "αβγ δεζη θικ αβγ")]
    assert 0.5 < got[4]["score"] < 1


def test_language_without_training_rows_is_undetermined(make):
    model = language.train(make([(1, "a", None, "s")]))
    assert [r["lang_pred"] for r in language.identify(make([(1, "abc", "en", "s")]), model).collect()] == ["und"]
    assert language.identify(make([]), model).count() == 0


def test_viterbi_is_optimal():
    rng = np.random.default_rng(2)
    counts = np.array([7, 1, 4])
    scores = rng.normal(size=(12, 3)).astype(np.float32) * 4
    labels = language.viterbi(scores, counts, 3.0)
    relative = np.maximum(scores - scores.max(axis=1, keepdims=True), -12)
    start = 0
    for n in counts:
        part = relative[start:start + n]

        def value(path):
            return sum(part[i, p] for i, p in enumerate(path)) - 3.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))

        paths = [[]]
        for _ in range(n):
            paths = [[*p, j] for p in paths for j in range(3)]
        assert value(labels[start:start + n].tolist()) == pytest.approx(max(map(value, paths)), abs=1e-4)
        start += n


def test_language_held_out_accuracy(spark):
    df = queries.QUERIES["op1_language_id"](spark, DATA)
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = df.where("held_out").collect()
    assert rows and sum(r["lang_pred"] == truth[r["doc_id"]] for r in rows) / len(rows) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in df.collect())


# -- 2 near duplicates


def shingle_sets(rows, k=5):
    out = {}
    for i, t, *_ in rows:
        w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in words(t)]
        out[i] = {tuple(w[j:j + k]) for j in range(max(len(w) - k + 1, 1))} if w else set()
    return out


def brute_components(sets):
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    up[y] = x
    return {i: find(i) for i in sets}


def test_near_duplicates_match_brute_force(make, corpus):
    got = near_dedup.near_duplicates(make(corpus)).collect()
    sets, want = shingle_sets(corpus), brute_components(shingle_sets(corpus))
    assert len(got) == len(corpus)
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], r["doc_id"] == want[r["doc_id"]])


@pytest.mark.parametrize("block, elements", [(512, 1 << 18), (16, 1 << 18), (512, 1000)])
def test_near_duplicates_of_a_large_group(make, monkeypatch, block, elements):
    """Chains inside a family: links hold between members that the pivot does
    not reach, whatever the blocks they are compared in."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "ELEMENTS", elements)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(150)] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(w), "en", "s"))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(make(rows)).collect()}
    assert got == brute_components(shingle_sets(rows))


def test_near_duplicates_of_nothing(make):
    assert near_dedup.near_duplicates(make([])).count() == 0
    got = near_dedup.near_duplicates(make([(None, "a b c d e f", "en", "s"), (4, "a b c d e f", "en", "s")])).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(None, None, True), (4, 4, True)}


def test_super_minhash_is_the_published_process():
    """Against one element after another, each with its own permutation."""
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 3, 50, 700)]
    fast = shingles.signatures(sets, 16)
    for s, row in zip(sets, fast, strict=True):
        slow = [None] * 16
        for e in s:
            places = list(range(16))
            for j in range(16):
                with np.errstate(over="ignore"):
                    draw = int(shingles.mix64(np.array([e]) + np.uint64((j + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))[0])
                k = j + ((draw >> 48) * (16 - j) >> 16)
                places[j], places[k] = places[k], places[j]
                offer = j << 48 | draw & (1 << 48) - 1
                if slow[places[j]] is None or offer < slow[places[j]]:
                    slow[places[j]] = offer
        assert slow == row.tolist()


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 2**63, (2, 400)).astype(np.uint64)
    x, y = np.unique(np.concatenate([a, b[:100]])), np.unique(np.concatenate([a[:300], b[:100]]))
    sig = shingles.signatures([x, y], 1024)
    assert (sig[0] == sig[1]).mean() == pytest.approx(400 / 500, abs=0.05)


@pytest.mark.parametrize("forest", [components.FOREST, 0])
def test_components_of_chains_and_stars(spark, monkeypatch, forest):
    """By one forest, and by star rounds alone where no table fits one."""
    monkeypatch.setattr(components, "FOREST", forest)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, j) for j in range(200, 300)] + [(300, 299), (5, 5)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    assert got == {**dict.fromkeys(range(101, 161), 100), **dict.fromkeys(range(200, 301), 7)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 3 lines


def test_recurring_lines_go_but_the_first_stays(make):
    rows = [(i, f"own text of document number {'abcdefghij'[i]} stays\nVisited on 2024-01-{i:02d} by user {i}\nshort line", "en", "s") for i in range(8)]
    rows += [(20, None, "en", "s"), (21, "", "en", "s"), (22, "all of this is nowhere else seen", "en", "s"), (None, "Visited on 2024-01-09 by user 9", "en", "s")]
    got = {r["doc_id"]: r for r in line_templates.drop_recurring_lines(make(rows), agreement=0.9).collect()}
    assert len(got) == 12
    assert "Visited" in got[0]["text"] and all("Visited" not in got[i]["text"] and "short line" in got[i]["text"] for i in range(1, 8))
    assert all(got[i]["text"].startswith("own text") for i in range(8))
    assert (got[20]["text"], got[20]["n_lines"]) == (None, 0) and got[21]["text"] == "" and got[22]["n_dropped"] == 0
    assert got[None]["n_dropped"] == 0


def brute_recurring(rows, depth=3, least=5, docs=5, agreement=0.6, rounds=2):
    left = []
    for i, t, *_ in rows:
        for n, line in enumerate((t or "").split("\n")):
            w = ["<*>" if re.search("[0-9]", x) else x for x in words(line)]
            if len(w) >= least:
                left.append((i, n, (len(w), *w[:depth]), w))
    gone = set()
    for _ in range(rounds):
        leaves = defaultdict(list)
        for x in left:
            leaves[x[2]].append(x)
        left = []
        for lines in leaves.values():
            if len({x[0] for x in lines}) < docs:
                continue
            template = []
            for p in range(len(lines[0][3])):
                token, n = Counter(x[3][p] for x in lines).most_common(1)[0]
                template.append(token if 2 * n >= len(lines) else "<*>")
            fit = [x for x in lines if sum(a == b for a, b in zip(x[3], template, strict=True)) >= agreement * len(template)]
            left += [x for x in lines if x not in fit]
            if len({x[0] for x in fit}) >= docs:
                gone |= {x[:2] for x in fit} - {min(x[:2] for x in fit)}
    return gone


def test_recurring_lines_match_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {(r["id"], r["line"]) for r in line_templates.recurring_lines(docs).collect()}
    want = brute_recurring(rows)
    assert got and len(got ^ want) <= 0.01 * len(want)  # equally common tokens are told apart by their hash


def test_recurring_lines_of_a_full_leaf_all_go(make):
    names = ["".join("abcdefghij"[int(c)] for c in f"{i:03d}") for i in range(300)]
    tails = ("red green blue white black", "one two three four five", "up down left right back")
    exact = [(i, f"it is a {tails[i % 3]}", "en", "s") for i in range(30)]
    alone = [(i, f"it was a {tails[0] if i < 10 else ' '.join(names[5 * i:5 * i + 5])}", "en", "s") for i in range(40)]
    varied = [(i, f"there is a {' '.join(tails[i % 3].split()[:4])} {names[i]}", "en", "s") for i in range(30)]
    numbers = [(i, f"{i} 5 6 {tails[i % 3]}", "en", "s") for i in range(30)]
    for rows, gone in ((exact, 27), (alone, 9), (varied, 27), (numbers, 27)):
        assert line_templates.recurring_lines(make(rows)).distinct().count() == gone


def test_rows_of_one_key_lose_only_their_own_lines(spark, make):
    line = "this very line is found in many documents"
    rows = [(i, f"{line}\nown {i}", "en", "s") for i in range(8)] + [(3, "a line that nobody else has at all\nand another one that is found nowhere else", "en", "s")]
    got = sorted((r["doc_id"], r["n_dropped"], r["text"]) for r in line_templates.drop_recurring_lines(make(rows)).collect())
    want = [(i, 0 if i == 0 else 1, rows[i][1] if i == 0 else f"own {i}") for i in range(8)] + [(3, 0, rows[8][1])]
    assert got == sorted(want)


def test_rewritten_rows_keep_columns_of_any_name(spark):
    rows = [(i, "the same long line in all of them", "mine", i, "x", "y", "z") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own string, id long, gone string, here string, counted string")
    found = line_templates.rewritten(docs)
    assert found.columns == [*docs.columns, "_lines"]
    assert {(r["own"], r["id"], r["gone"], r["here"], r["counted"]) for r in found.collect()} == {("mine", i, "x", "y", "z") for i in range(6)}


def test_lines_that_share_only_their_leading_tokens_stay(make):
    names = ["".join("abcdefghij"[int(c)] for c in f"{i:03d}") for i in range(200)]
    rows = [(i, f"it is a {names[2 * i]} {names[2 * i + 1]}\nit is a {names[i]} {names[i + 50]} 7\n1 2 3 {names[i]} 5 6", "en", "s") for i in range(50)]
    assert line_templates.recurring_lines(make(rows)).count() == 0
    rows = [(i, f"{t} the same word {names[i]}", "en", "s") for i, (_, t, *_) in enumerate(rows)]
    assert {r["line"] for r in line_templates.recurring_lines(make(rows)).collect()} == {2}


# -- 4 packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing_keeps_every_token(make, corpus, tokenizer, capacity):
    rows = [*corpus, (4000, "İstanbul ﬁne\u00a0space\u2003e\u0301 <|endoftext|> it's 12,000%", "en", "s")]
    got = packing.pack_documents(make(rows), public_tokenizers.path("word_bpe_49k.json"), 1, capacity).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"], r["piece"]].append(r)
    for i, t, *_ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for n, start in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[start:start + capacity], "<u4")
            assert all((r["start"], r["length"], r["ids_crc32"]) == (start, len(part), zlib.crc32(part.tobytes())) for r in pieces[i, n])
    total = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in rows)
    assert sum(r["length"] for r in got) == total
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) <= 1.05 * total / capacity + 2


def test_special_tokens_have_their_own_ids(tokenizer):
    import pyarrow as pa

    cut = packing.ChunkTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(9)
    alphabet = "abcXYZ'sTe09_!#ÀßñÿŁİıǅ×÷ª½Ωσς漢ｅ\u0301\u00a0\u2003\u200b\u0085\x1c\x00😀 \n\t<|>"
    texts = ["a <|endoftext|> b", "x<|startoftext|>y", "<|EndOfText|>", "it's we'LL !!'s", None, "", " \n ", "a" * 3000]
    texts += ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(3000)]
    ids, at = cut.ids(pa.array(texts))
    got = [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert got[0] == [320, 49407, 321]


def test_tokens_of_a_chunk_and_of_its_words_are_remembered_once(tokenizer, monkeypatch):
    import pyarrow as pa

    cut = packing.ChunkTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(packing, "KNOWN", 40)
    texts = ["pain pain. (pain) it's", "PAIN it 's ' s", "12 1 don't 't n't"] + [f"w{i}x, w{i} x{i} '{i}'s" for i in range(60)]
    for t in [*texts, *reversed(texts)]:
        ids, _ = cut.ids(pa.array([t]))
        assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    cut = packing.ChunkTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    cut.ids(pa.array(["pain fever pain. it's"]))
    remembered = [name for held in vars(cut).values() if isinstance(held, dict) for name in held]
    assert sorted(remembered) == sorted(["pain", "fever", "pain.", ".", "it's", "it", "'s"])


def test_packing_an_empty_table(make):
    assert packing.pack_documents(make([]), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_nonnegative_fit_and_patterns():
    parts = packing.patterns(24)
    assert all(sum(row) == 24 for row in parts.tolist()) and len({tuple(r) for r in parts.tolist()}) == len(parts)
    assert len(parts) == 1 + 12 + sum(1 for a in range(1, 25) for b in range(1, a + 1) for c in range(1, b + 1) if a + b + c == 24)
    rng = np.random.default_rng(4)
    true = np.where(rng.random(len(parts)) < 0.2, rng.integers(1, 50, len(parts)), 0)
    target = np.zeros(24)
    for p, n in zip(parts.tolist(), true.tolist(), strict=True):
        for c in filter(None, p):
            target[c - 1] += n
    x = packing.nonnegative_fit(parts, target)
    assert (x >= 0).all()
    back = np.zeros(24)
    for p, n in zip(parts.tolist(), x.tolist(), strict=True):
        for c in filter(None, p):
            back[c - 1] += n
    assert np.allclose(back, target, atol=1e-3)


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(6)
    lengths = np.minimum(rng.lognormal(6.3, 1.0, 20000).astype(int) + 1, 4096)
    histogram = dict(Counter(lengths.tolist()))
    plan = packing.plan_sequences(histogram, 4096)
    assert plan.sequences <= lengths.sum() / 4096 * 1.01 + 1
    assert sum(high - low for _, low, high, _, _ in plan.rows) == len(lengths)


# -- 5 passages


def brute_removed(rows, k=35):
    seen = Counter()
    for _, t, *_ in rows:
        w = words(t)
        seen.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = {}
    for i, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if seen[tuple(w[j:j + k])] > 1:
                gone[j:j + k] = [True] * k
        left = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest())
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 1500])
def test_repeated_passages_match_brute_force(make, corpus, block_bytes):
    got = repeated_passages.remove_repeats(make(corpus), block_bytes=block_bytes).collect()
    want = brute_removed(corpus)
    assert len(got) == len(corpus)
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]]


def test_rows_of_one_key_spread_over_the_blocks(make):
    rng = random.Random(7)
    text = lambda n: " ".join(str(rng.random()) for _ in range(n))
    shared = text(60)
    rows = [(None, text(90), "en", "s") for _ in range(60)] + [(None, shared, "en", "s")] * 40 + [(7, f"{text(5)} {shared}", "en", "s")]
    docs = make(rows).select(F.col("doc_id").alias("k"), F.col("text").alias("t"))
    dealt = repeated_passages._dealt(docs, 20, 5000).collect()
    assert len(dealt) == 62 and max(Counter(r["block"] for r in dealt).values()) < 15
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in repeated_passages.remove_repeats(make(rows), block_bytes=5000).collect())
    assert got == sorted([("None", 90, 0)] * 60 + [("None", 60, 60)] * 40 + [("7", 65, 60)])


def test_repeated_passages_of_nothing(make):
    assert repeated_passages.remove_repeats(make([])).count() == 0


def test_automaton_reads_only_documents_with_a_confirmed_window(monkeypatch):
    read = []

    class Counted:
        def __init__(self, *kind):
            self.machine = plain_automaton(*kind)

        def __len__(self):
            return len(self.machine)

        def __getattr__(self, name):
            return getattr(self.machine, name)

        def iter(self, sequence):
            read.append(len(sequence))
            return self.machine.iter(sequence)

    plain_automaton = repeated_passages.ahocorasick.Automaton
    monkeypatch.setattr(repeated_passages.ahocorasick, "Automaton", Counted)
    rng = random.Random(1)
    plain = [[str(rng.random()).encode() for _ in range(n)] for n in (0, 20, 90, 120, 35, 20, 90)]
    shared = [str(i).encode() for i in range(40)]
    documents = [*plain[:5], [*plain[5], *shared], [*shared, *plain[6], *shared[:34]]]
    hashes = [repeated_passages._rolled(repeated_passages.mix64(shingles.word_hashes(d)), 35) for d in documents if len(d) >= 35]
    values, times = np.unique(np.concatenate(hashes), return_counts=True)
    got = repeated_passages.covered_words(documents, values[times > 1])
    assert read == [60, 164]
    assert [g.tolist() for g in got[:5]] == [[False] * len(d) for d in plain[:5]]
    assert np.flatnonzero(got[5]).tolist() == list(range(20, 60)) and np.flatnonzero(got[6]).tolist() == list(range(40))


# -- 6 HTML


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("<html><body></body></html>", ""), ("plain &amp; simple", "plain & simple"),
    ("<body><nav><a href=/>Home</a></nav><article><h1>T &lt;1&gt;</h1><p>One<b>two</b>\n three<br>four<p>five</article><footer>f</footer>", "T <1> Onetwo three four five"),
    ("<div class='cookie-notice'>We use cookies</div><main><p>Body text here is long enough.</p><p>More of it, too.</p></main><div id=comments><p>First!</p></div>",
     "Body text here is long enough. More of it, too."),
    ("<article><p>a</p><script>var x='</p><p>no';</script><style>p{}</style><!-- <p>no --><form><input>no</form><aside>no</aside><p>b &quot;c&quot; &am</p></article>",
     'a b "c" &am'),
    ("<body><header><p>Site name and slogan</p></header><div><section><p>Long first paragraph of text.</p><p>Another good paragraph.</p></section>"
     "<section><p>The second section goes on.</p><p>And it ends here.</p></section></div><div class=sidebar><p>Links</p></div>",
     "Long first paragraph of text. Another good paragraph. The second section goes on. And it ends here."),
    ("<body><ul><li><a href=a>One link</a></li><li><a href=b>Two links</a></li><li><a href=c>Three</a></li></ul><div><p>Real prose stands in this place.</p>"
     "<p>It has sentences.</p></div>", "Real prose stands in this place. It has sentences."),
    ("<article><nav><ul><li>menu</article>", ""), ("<nav><ul><li>menu<article><p>kept text</p></article>", "kept text"),
    ("<article class='post'><p>Own text.</p><section id='comments'><article class='comment-body'><p>Nice!</p></article></section></article>", "Own text."),
    ("<main><p>Own text.</p></main><article class='related-post'><p>Another page</p></article>", "Own text."),
    ("<p title='a>b\">unbalanced <i>x</i></p>", None),
])
def test_main_text(page, text):
    got = html_text.main_text(page)
    assert text is None or got == text


@pytest.mark.parametrize(("page", "text"), [
    ("<div><p class=ad>Buy this<p>First words of it.<p>And more words.</div><p>The end of it.</p>", "First words of it. And more words. The end of it."),
    ("<article><ul><li class=promo>Buy<li>First point here.<li>Second point here.</ul><p>The end of it.</p></article>",
     "First point here. Second point here. The end of it."),
    ("<article><div><nav><ul><li>menu</div><p>Text of the article.</p></article>", "Text of the article."),
    ("<article><p>Text <button><div>menu</div></button>goes on.</p></article>", "Text goes on."),
    ("<div class='page no-sidebar'><p>The page's own text is long enough.</p><nav><p>menu</p></nav></div><div class=sidebar><p>Links</p></div>",
     "The page's own text is long enough."),
])
def test_dropped_elements_end_like_others(page, text):
    assert html_text.main_text(page) == text


def test_short_sections_of_the_article_stay():
    many, few = "<p>" + "long words " * 27 + "</p>", "<p>" + "more words " * 27 + "</p>"
    first, second = " ".join(["long words"] * 270), " ".join(["more words"] * 54)
    sections = f"<section>{many * 10}</section><section>{few * 2}</section>"
    assert html_text.main_text(f"<article>{sections}</article>") == f"{first} {second}"
    # outside an article the density decides: direct text has one, but no children to sum up
    assert html_text.main_text(f"<div><section>{many * 10}</section><section>{second}</section></div>") == f"{first} {second}"
    page = (f"<article><header><h1>Title</h1></header><div>{many * 10}</div><div>Direct text.</div>"
            "<div><a href=a>Other page</a></div></article><div><a href=b>Far page</a></div>")
    assert html_text.main_text(page) == f"Title {first} Direct text."


def test_main_text_of_deep_and_long_pages():
    deep = "<div>" * 5000 + "<p>bottom text</p>" + "</div>" * 5000
    assert html_text.main_text(deep) == "bottom text"
    long = "<article>" + "<p>word word</p>" * 20000 + "</article>"
    assert html_text.main_text(long) == " ".join(["word word"] * 20000)


def test_extraction_returns_every_page(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a b</p>", "x"), (1, "u", "<p>a b</p>", "x"), (2, None, None, "x")], "page_id long, url string, html string, text string")
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract_pages(pages).collect()) == [(1, "a b", 3), (1, "a b", 3), (2, "", 0)]
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def test_extraction_matches_the_articles(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    import html

    for r in queries.QUERIES["op6_html_extraction"](spark, DATA).collect():
        body = pages[r["page_id"]].partition("<article>")[2].partition("</article>")[0]
        assert r["text"] == " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", body))).split())


# -- 7 URLs


def test_url_verdicts(spark):
    cases = {
        None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "http://A.Example.ORG/es/1": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "http://example.org/en/12?q": ("example.org", "/en/12", "example.org/en/1", "block"), "http://x.org": ("x.org", "", None, "allow"),
        "http://x.org/": ("x.org", "/", "org/", "allow"), "https://www.cheap-pills.example.com/fr/1": ("www.cheap-pills.example.com", "/fr/1", "com/fr/", "allow"),
        "https://www.cheap-pills.example.com/it/1": ("www.cheap-pills.example.com", "/it/1", None, "block"), "http://myorg/es/": ("myorg", "/es/", None, "allow"),
        "http://news.net/cheap/pills": ("news.net", "/cheap/pills", None, "allow"), "http://n.net/a/login?x=1": ("n.net", "/a/login", None, "block"),
        "http://CASINO-WIN.example.net#t": ("casino-win.example.net", "", None, "block"), "": ("", "", None, "allow"), "http://h.net?p://x/y": ("h.net", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(cases)] * 2, "page_id long, url string, host string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages).collect()}
    assert got == dict(enumerate(cases.values()))
    assert url_filter.judge_urls(pages).count() == 2 * len(cases) and url_filter.judge_urls(pages.limit(0)).count() == 0


def test_token_index_uses_the_rarest_token(spark):
    pages = spark.createDataFrame([(1, "http://free.net"), (2, "http://free-bets.net"), (3, "http://x.net/free")], "page_id long, url string")
    rules = (url_filter.PatternRule("free-bets", ("free", "bets")),)
    assert set(url_filter.token_index(pages, rules)) == {"bets"}
    assert [r["verdict"] for r in url_filter.judge_urls(pages, (), rules).orderBy("page_id").collect()] == ["allow", "block", "allow"]
    assert {r["verdict"] for r in url_filter.judge_urls(pages, (), ()).collect()} == {"allow"}


def test_every_pattern_match_has_its_tokens():
    for rule in url_filter.PATTERNS:
        for url in ("http://www.%s.net/", "http://n.net/%s/", "http://n.net/%s"):
            candidate = url % ("-".join(rule.tokens) + "-x" if "adult" in rule.tokens else "-".join(rule.tokens))
            if re.search(rule.regex, candidate):
                assert set(rule.tokens) <= set(re.split("[^a-z0-9]+", candidate))
                break
        else:
            raise AssertionError(rule)


# -- 8 fingerprints


def test_fingerprints_match_brute_force(make, corpus, spark):
    rows = list(dict(((r[0], r) for r in corpus)).values())
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(make(corpus[:-1])).collect()}
    assert len(got) == len(rows)
    rows.sort(key=lambda r: r[0])
    texts = [r[1] or "" for r in rows]
    for i, (k, *_rest) in enumerate(rows):
        t, nxt = texts[i], texts[(i + 1) % len(texts)]
        q = len(t) // 4
        changed = t[:len(t) - q] + nxt[:q]
        r = got[k]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        for a, b in ((r["fingerprint"], t), (r["edited_fingerprint"], changed)):
            assert a == fingerprints.PrefixHash(fingerprints.code_points(b)).fingerprint()
        common = next((j for j, (x, y) in enumerate(zip(t, changed, strict=False)) if x != y), min(len(t), len(changed)))
        assert r["common_edited"] == common
        assert 0 <= r["near_next"] <= 1 and (r["near_edited"] > 0.6 or len(t) < 4 or t == changed)


def test_fingerprint_edges(make):
    one = fingerprints.fingerprint_documents(make([(1, "abcdefgh", "en", "s")])).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    tied = fingerprints.fingerprint_documents(make([(1, "same", "en", "s"), (1, "same", "en", "s"), (None, None, "en", "s")])).collect()
    assert sorted(r["near_next"] for r in tied) == [0, 0, 1]
    assert fingerprints.fingerprint_documents(make([])).count() == 0


def test_prefix_hash_answers_spans_and_extensions():
    rng = random.Random(9)
    a, b = ("".join(rng.choices("ab", k=300)) for _ in range(2))
    x, y = (fingerprints.PrefixHash(fingerprints.code_points(t)) for t in (a, b))
    for _ in range(300):
        i, j, n = rng.randrange(290), rng.randrange(290), rng.randint(0, 10)
        assert x.equal(i, y, j, n) == (a[i:i + n] == b[j:j + n])
        want = 0
        while i + want < 300 and j + want < 300 and a[i + want] == b[j + want]:
            want += 1
        assert x.common_extension(i, y, j) == want


def test_likeness():
    def fp(t):
        return fingerprints.PrefixHash(fingerprints.code_points(t)).fingerprint()

    t = "".join(random.Random(1).choices("abcdef ", k=5000))
    assert fingerprints.likeness(fp(t), fp(t)) == 1 and fingerprints.likeness(fp(""), fp("")) == 1 and fingerprints.likeness(fp(""), fp("a")) == 0
    assert fingerprints.likeness(fp(t), fp(t[:2000] + "X" + t[2001:])) > 0.9
    assert fingerprints.likeness(fp(t), fp(t[::-1])) < 0.1


# -- 9 mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    total = sum(sizes.values())
    while open_:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not above:
            target |= share
            break
        target |= {s: 3.0 * sizes[s] for s in above}
        open_ -= above
    return target


def test_mixing_meets_its_targets(make, corpus):
    rng = random.Random(3)
    rows = [*corpus, *[(5000 + i, "w " * rng.randint(1, 300), "en", rng.choice("dddddddé")) for i in range(300)], (9000, None, "en", "zero"),
            (9001, "tiny", "en", "small")]
    df = make(rows)
    got = mixing.mix_sources(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_sources(df).collect()), key=str)
    sizes = Counter()
    for i, t, _, s in rows:
        sizes[s] += len(words(t))
    want = brute_targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], abs=1e-6)
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(got) == len(rows)
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.05 * t + 60


def test_mixing_rates_solve_the_dual(make):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(1, 100), "en", "abc"[i % 3]) for i in range(600)]
    got = mixing.mix_sources(make(rows)).collect()
    for s in "abc":
        part = [r for r in got if r["source"] == s]
        assert sum(r["rate"] * r["size"] for r in part) == pytest.approx(part[0]["target"], rel=1e-4)
        free = [r for r in part if 0 < r["rate"] < 3]
        slopes = [np.log(r["rate"]) / r["size"] for r in free]
        assert np.ptp(slopes) < 1e-9  # exponential in the size


def test_mixing_solves_a_source_whose_documents_all_reach_the_cap(spark):
    histogram = spark.createDataFrame([("a", 100, 1), ("b", 110, 50)], "source string, size long, n long")
    targets = spark.createDataFrame([("a", 100, 1, 250.0), ("b", 5500, 1, 12100.0)], "source string, source_size long, weight int, target double")
    got = {r["source"]: r["multiplier"] for r in mixing.balance(histogram, targets).collect()}
    assert got == pytest.approx({"a": np.log(2.5), "b": np.log(2.2)}, abs=1e-5)


def test_mixing_an_empty_table(make):
    assert mixing.mix_sources(make([])).count() == 0
    assert [r["taken"] for r in mixing.mix_sources(make([(1, None, None, None), (2, "", None, "a")])).collect()] == [0, 0]


# -- 10 quality


def brute_statistics(text):
    t = text or ""
    w = words(t)
    seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    gone = set()
    for i in range(len(w) - 7):
        if seen[tuple(w[i:i + 8])] > 1:
            gone.update(range(i, i + 8))
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(gone)


def test_statistics_match_brute_force(make, corpus):
    rng = random.Random(2)
    odd = [(7000 + i, "".join(rng.choices("ab# \n\t|é😀", k=rng.randint(0, 400))), "en", "s") for i in range(60)]
    rows = [*corpus, *odd, (8000, "a b c d e f g h " * 3 + "x\u00a0y\u0085z \r\n\x0b\x0c", "en", "s")]
    got = quality_rules.text_statistics(make(rows)).collect()
    texts = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_statistics(texts[r["doc_id"]])


@pytest.mark.parametrize("k", [1, 2, 3, 7, 8, 9])
def test_repeated_words_of_any_window_match_brute_force(spark, k):
    rng = random.Random(k)
    texts = [rng.choices("ab", k=n) for n in range(12)] + [rng.choices("abcdef", k=rng.randint(0, 60)) for _ in range(60)] + [["a"] * 40]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "_hashes long, _at array<string>")
    got = quality_rules.with_repeated_words(rows, "_at", "n", k).collect()
    assert len(got) == len(texts)
    for r in got:
        w = texts[r["_hashes"]]
        seen = Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
        assert r["n"] == len({i + j for i in range(len(w) - k + 1) if seen[tuple(w[i:i + k])] > 1 for j in range(k)}) and r["_at"] == w


def test_statistics_evaluate_each_window_hash_once(make):
    plan = quality_rules.text_statistics(make([(1, "a b", "en", "s")]))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("xxhash64(") <= 4 and plan.count("sort_array(") <= 2


def test_rules_separate_labelled_rows(spark, make):
    rng = random.Random(6)
    rows = [(i, " ".join(("x#" if i % 5 == 0 else "x") + str(rng.random()) for _ in range(30)), "en", "s") for i in range(400)]
    labels = spark.createDataFrame([(i, 0 if i % 5 == 0 else 1, 0) for i in range(0, 400, 2)] + [(None, 0, 0), (3, None, 0), (1, 1, 0), (1, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    got = quality_rules.judge_quality(make(rows), labels).collect()
    assert all(r["kept"] == (r["doc_id"] % 5 != 0) and not r["base_failed"] for r in got)


def test_without_labels_only_the_base_test_rejects(spark, make, corpus):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for r in quality_rules.judge_quality(make(corpus), labels).collect():
        assert r["kept"] == (not r["base_failed"]) == (not (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]))
    assert quality_rules.judge_quality(make([]), labels).count() == 0


def test_rules_agree_with_the_labels_of_the_tables(spark):
    got = queries.QUERIES["op10_quality_rules"](spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id")
    wrong = got.where((F.col("quality") == 0) == F.col("kept")).where("NOT base_failed").count()
    assert wrong <= 0.03 * got.count()
