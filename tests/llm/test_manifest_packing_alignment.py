"""Manifest, packing and alignment against brute force, on awkward rows."""

import bisect
import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from gaugeworks.llm import alignment, merkle, packing, words

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree int, idx int, leaf string, slice int, piece string, part int, pairs int"
ODD = " \n\t\r\x0b\x1c\x85\xa0 　᠎​<s>'sab1é中!\U0001f600"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    vocab = ["the", "Of", "réseau", "zwölf", "x1", "42", "foo_bar", "end.", "und,", "中文", "<|endoftext|>", "</s>"]
    texts = [None, "", " ", "\n\n", "a", "one ▁ lower block", "  two  blanks  ", "x" * 5000, " ".join(rng.choices(vocab, k=9000))]
    for _ in range(120):
        texts.append("".join(rng.choices(ODD + " " * 8, k=rng.randrange(60))) + " " + " ".join(rng.choices(vocab, k=rng.choice([1, 5, 40, 300]))))
    sources = ["big", "big", "big", "B", "b", "é", None, ""]
    out = [(i, rng.choice(sources), rng.choice([None, "en"]), rng.choice([None, len(t or "")]), t) for i, t in enumerate(texts)]
    out += [(i, "many", "en", 1, f"Text {i}") for i in range(1000, 1300)]
    out += [out[20]] * 3 + [(4, "big", "en", 2, "Another"), (None, "big", "en", 1, "No Id"), (-7, "b", None, 1, "Abc"), (5000, "lone", None, None, "ABC")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns of names that the operators use themselves."""
    return spark.createDataFrame([(*r, 1, 2, "l", 3, "p", 4, 5) for r in rows], SCHEMA).repartition(5)


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---------------------------------------------------------------- 11 manifest
def brute_leaf(row) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_levels(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def brute_path(levels, i):
    for level in levels[:-1]:
        yield i % 16, level[i // 16 * 16 : i // 16 * 16 + 16]
        i //= 16


def brute_manifest(rows) -> list[tuple]:
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for own in by.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r)))
    trees = {s: brute_levels([brute_leaf(r) for r in by[s]]) for s in names}
    over, out = brute_levels([trees[s][-1][0] for s in names]), []
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            path = [*brute_path(trees[s], i), *brute_path(over, k)]
            text = r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = text.translate({c: c + 32 for c in range(65, 91)})
            value = brute_leaf((*r[:4], text))
            for j, run in path:
                value = sha("".join([*run[:j], value, *run[j + 1 :]]))
            proof = sha("".join("".join(run[:j] + run[j + 1 :]) for j, run in path))
            out.append((r[0], brute_leaf(r), trees[s][-1][0], over[-1][0], proof, value, value == over[-1][0]))
    return sorted(out, key=repr)


def test_manifest_equals_brute_force(docs, rows):
    got = values(merkle.tampered(docs))
    assert got == brute_manifest(rows)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 16, 17, 256, 257])
def test_manifest_of_full_and_lone_runs(spark, n):
    rows = [(i, "s", None, i, "Q") for i in range(n)]
    assert values(merkle.tampered(spark.createDataFrame([(*r, 1, 2, "l", 3, "p", 4, 5) for r in rows], SCHEMA).repartition(7))) == brute_manifest(rows)


def test_manifest_of_many_sources_and_equal_rows(spark):
    rows = [(i % 7, f"s{i % 40:02}", "en", 1, "X") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert values(merkle.tampered(df)) == brute_manifest(rows)


def test_a_path_folds_to_the_root(docs):
    for r in merkle.manifest(docs, with_path=True).collect():
        assert r.verified and merkle.fold(bytes.fromhex(r.leaf), [(s.place, bytes(s.siblings)) for s in r.path]).hex() == r.root


# ----------------------------------------------------------------- 12 packing
@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_pieces_are_those_of_the_library_and_lie_side_by_side(docs, rows, library):
    got = packing.pack(docs).collect()
    want = Counter()
    for d, *_, text in rows:
        ids, start = [*library.encode(text or "", add_special_tokens=False).ids, 2], 0
        sizes = [len(ids)] if len(ids) <= 1024 else [*filter(None, [len(ids) % 1024]), *[1024] * (len(ids) // 1024)]
        for piece, n in enumerate(sizes):
            want[d, piece, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())] += 1
            start += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [0, *itertools.accumulate(n for _, n in own)][:-1] and sum(n for _, n in own) <= 1024
    assert len(by) <= best_fit([r.length for r in got]) and sorted(by) == list(range(len(by)))
    assert packing.pack(docs.where("false")).count() == 0


def best_fit(lengths) -> int:
    """Sequences that best-fit decreasing takes."""
    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, x)
        n += at == len(gaps)
        bisect.insort(gaps, (gaps.pop(at) if at < len(gaps) else 1024) - x)
    return n


def test_exact_sums_equal_all_combinations():
    rng = random.Random(3)
    for _ in range(60):
        have = rng.choices(range(1, 25), k=rng.randrange(1, 9))
        stock = packing.Stock(np.bincount(have, minlength=41))
        for _ in range(12):
            gap = rng.randrange(1, 41)
            can = {n for n in (1, 2, 3) for c in itertools.combinations(have, n) if sum(c) == gap}
            found = stock.exact(gap)
            assert len(found) == min(can, default=0) and sum(found) == (gap if can else 0)
            if found and rng.random() < 0.5:
                stock.take(found)
                for f in found:
                    have.remove(f)


@pytest.mark.parametrize("low, high", [(1, 40), (1, 1025), (300, 700), (513, 1025), (1024, 1025)])
def test_plans_use_all_pieces_and_few_sequences(low, high):
    count = np.bincount(np.random.default_rng(1).integers(low, high, 4000), minlength=1025)
    planned, used = packing.plan(count), Counter()
    for times, each in planned:
        assert 0 < sum(n * k for n, k in each.items()) <= 1024
        used.update({n: times * k for n, k in each.items()})
    assert used == Counter({n: int(k) for n, k in enumerate(count) if k})
    assert sum(t for t, _ in planned) <= best_fit(np.repeat(np.arange(1025), count).tolist())
    assert len(packing.plan(count * 10**6)) < 4096


# --------------------------------------------------------------- 13 alignment
@pytest.fixture(scope="module")
def both(library):
    a, b = Tokenizer.from_file(P.path("byte_bpe_50k.json")), SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    byte = {c: b for c, b in words._byte_of().items()}

    def b_bytes(i):
        return bytes([b.id_to_piece(i).startswith("<0x") and int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def tokens(text):
        if not text:
            return [], []
        own = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        other = [(i, b_bytes(i)) for i in b.encode(text)]
        same = all(b"".join(t for _, t in x) == (" " + text).encode() for x in (own, other))
        return (own, other) if same else ([], [])

    return tokens


def brute_groups(a, b):
    ends = [list(itertools.accumulate(len(t) for _, t in x)) for x in (a, b)]
    out, links, p, q = [], [], 0, 0
    for i, e in enumerate(ends[0]):
        if e in ends[1]:
            j = ends[1].index(e)
            out.append(",".join(str(t) for t, _ in a[p : i + 1]) + "|" + ",".join(str(t) for t, _ in b[q : j + 1]))
            links.append((a[i][0], b[j][0]))
            p, q = i + 1, j + 1
    return out, links


def test_alignment_equals_brute_force(docs, rows, both, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE_BYTES", 3000)
    texts = {t: both(t) for *_, t in rows}
    done = {t: brute_groups(*x) for t, x in texts.items()}
    count = Counter(link for *_, t in rows for link in done[t][1])
    most = [{s: max(n for pair, n in count.items() if pair[k] == s) for s in {p[k] for p in count}} for k in (0, 1)]
    want = []
    for d, *_, t in rows:
        (a, b), (groups, links) = texts[t], done[t]
        best = [sum(count[x] == most[k][x[k]] for x in links) for k in (1, 0)]
        want.append((d, len(a), len(b), len(groups), len(links), *best, sum(count[x] for x in links), sha(";".join(groups)) if a else ""))
    got = values(alignment.align(docs))
    assert got == sorted(want, key=repr)
    assert sum(r[1] == 0 for r in got) >= 3 and any(r[1] > 5000 for r in got)
    assert alignment.align(docs.where("false")).count() == 0
    table = alignment.pair_table(alignment._aligned(docs, (*words.default_byte_level(), words.default_pieces())))
    assert {(r.a_id, r.b_id): r.links for r in table.collect()} == count


def test_a_text_in_blocks_has_the_tokens_of_the_whole(both, library, monkeypatch):
    monkeypatch.setattr(words, "BLOCK", 30)
    rng = random.Random(9)
    a, b = words.default_byte_level(), words.default_pieces()
    aligner, vocab = alignment.Aligner(*a, b), words.byte_level(*a)
    texts = ["".join(rng.choices(ODD + "    ", k=rng.randrange(150))) + rng.choice(["", "<|endoftext|>", " <|endoftext|> x"]) for _ in range(600)]
    assert max(len(list(words.blocks(t))) for t in texts) > 2
    done = alignment._slice(aligner, pa.record_batch([pa.array(range(600), pa.int64()), pa.array(texts)], names=["doc_id", "text"]), 0).to_pylist()
    for text, got in zip(texts, done):
        assert np.frombuffer(packing._ids(vocab, text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        x, y = both(text)
        groups, links = brute_groups(x, y)
        assert (got["n_a"], got["n_b"], got["n_groups"], got["groups_sha256"]) == (len(x), len(y), len(groups), sha(";".join(groups)) if x else "")
        pairs = {done[0]["pairs"][i]: n for i, n in zip(got["local"], got["times"])}
        assert pairs == Counter(p << 20 | q for p, q in links)


def test_blocks_lose_nothing_but_their_blanks(monkeypatch):
    monkeypatch.setattr(words, "BLOCK", 10)
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choices("ab \n", k=rng.randrange(120)))
        assert " ".join(words.blocks(text)) == text
