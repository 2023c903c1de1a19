"""The pipeline against a chain of the brute-force operators."""

import math
import random

import public_tokenizers as P
import pytest
import tiktoken
from test_llm_operators import brute_components, brute_fingerprint, brute_leaks, brute_lines, brute_model, prose, sha, symbols
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline
from gaugeworks.llm import kneser_ney

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, root = random.Random(11), tmp_path_factory.mktemp("sf")
    line = "this very line stands in a lot of the documents"
    items = [(i, prose(rng, 30)) for i in range(4)]
    texts: list[str | None] = [None, "", "zq%$#@!" * 200]
    for i in range(70):
        own = prose(rng, rng.choice([30, 80, 200]))
        if i % 3 == 0:
            own = f"{own}\n{line}\nend {i}"
        if i % 10 == 4:
            own += " " + rng.choice(items)[1] + " " + prose(rng, 9)
        texts.append(own)
    texts += [texts[20], texts[21] + " more", "\n".join([line] * 3), texts[2]]
    rows = [(i, t, [None, "en", "de"][i % 3], "web", len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, 1, 0) for i in range(3, 50)] + [(2, 0, 1)]
    write = lambda name, data, schema: spark.createDataFrame(data, schema).write.parquet(f"{root}/{name}.parquet")
    write("documents", rows, COLUMNS)
    write("labels", labels, "doc_id long, quality int, toxic int")
    write("benchmark", items, "item_id long, text string")
    return str(root), rows, {x[0] for x in labels if x[1] == 1}, items


def brute_floor(p, text: str) -> float:
    s = symbols(text)
    nll = [-math.log(p(tuple(s[i : i + 3]))) for i in range(len(s) - 2)]
    mean = sum(nll) / len(nll)
    spread = math.sqrt(max(sum(x * x for x in nll) / len(nll) - mean**2, 0))
    return math.exp(mean - 2 * max(spread, 1) / math.sqrt(len(nll)))


def brute_quality(rows, trusted):
    p = brute_model([t or "" for d, t, *_ in rows if d in trusted])
    floor = {d: brute_floor(p, t or "") for d, t, *_ in rows}

    def limit(ids):
        f = sorted(floor[d] for d in ids)
        return f[math.ceil(0.99 * len(f)) - 1] * 1.05

    lang = {d: l for d, _, l, *_ in rows}
    limits = {l: limit([d for d in trusted if l is None or lang[d] == l]) for l in set(lang.values())}
    return [r for r in rows if floor[r[0]] <= limits[r[2]] * (1 + 1e-6)]


def brute_run(rows, trusted, items):
    kept = brute_quality(rows, trusted)
    assert not {2, len(rows) - 1} & {r[0] for r in kept} and len(kept) > 60
    cut = {d: h for d, _, _, h in brute_lines([(r[0], r[1] or "") for r in kept])}
    return kept, cut


def test_pipeline_equals_brute_force(spark, tables):
    root, rows, trusted, items = tables
    kept, cut = brute_run(rows, trusted, items)
    docs, by_stage = spark.read.parquet(f"{root}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, root)
        by_stage[name] = {r.doc_id: r for r in docs.collect()}
        assert set(spark.read.parquet(f"{root}/documents.parquet").columns) <= set(docs.columns)

    assert set(by_stage["quality"]) == {r[0] for r in kept}
    lines = by_stage["line_dedup"]
    assert set(lines) == {r[0] for r in kept if not (cut[r[0]] == sha("") and r[1])}
    assert all(sha(r.text or "") == cut[d] and r.n_chars == len(r.text or "") for d, r in lines.items() if r.text is not None)
    ids = sorted(lines)
    group = brute_components([brute_fingerprint(lines[d].text or "") for d in ids], ids)
    assert set(by_stage["near_dedup"]) == set(group) and len(set(group)) < len(ids)
    near = by_stage["near_dedup"]
    clean = {d for d in near if not brute_leaks(near[d].text or "", items)}
    assert set(by_stage["decontamination"]) == clean and len(clean) < len(near)
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=load_tiktoken_bpe(str(P.path("byte_bpe_50k.tiktoken"))), special_tokens={})
    done = {r.doc_id: r for r in corpus_pipeline.run(spark, root).collect()}
    assert set(done) == clean
    for r in done.values():
        assert r.ids == enc.encode_ordinary(r.text or "") and r.n_tokens == len(r.ids)


def test_pipeline_of_an_empty_table(spark, tables):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables[0])
    assert docs.count() == 0


def test_a_stage_lets_other_columns_through(spark, tables):
    root, rows, *_ = tables
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows[:20]], COLUMNS + ", keep int, held string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, root).columns == docs.columns
    assert kneser_ney.classify(docs, spark.read.parquet(f"{root}/labels.parquet")).count() == 20
