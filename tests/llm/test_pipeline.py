"""The pipeline's stages against what the operators decide, row by row."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from cubespan.llm import mixing, quality, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, docs, rows, tmp_path):
    now, seen = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, "").write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert after.columns == docs.columns
        seen.append((now.collect(), after.collect()))
        now = after
    before, after = seen[0]
    kept = {r.doc_id for r in quality.line_first(docs).where("kept").collect()}
    assert {r.doc_id for r in after} == kept and all(r.n_chars == len(r.text) for r in after)
    before, after = seen[1]
    sets = {r.doc_id: {tuple(w[k : k + 5]) for w in [WORD.findall(r.text.lower())] for k in range(len(w) - 4)} for r in before}
    left = {r.doc_id for r in after}
    assert len(after) == len(left)
    assert all(i in left or any(len(s & sets[j]) >= 0.8 * len(s | sets[j]) for j in sets if j != i) for i, s in sets.items())
    assert not any(5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for i in left for j in left if i < j)
    before, after = seen[2]
    assert {r.doc_id for r in before} == {r.doc_id for r in after} and not any("3f9a0c1d2e4b5a6978" in r.text for r in after)
    before, after = seen[3]
    sizes, taken = defaultdict(int), defaultdict(int)
    text = {r.doc_id: r for r in before}
    for r in before:
        sizes[r.source] += len(WORD.findall(r.text))
    for r in after:
        taken[r.source] += len(WORD.findall(r.text))
        assert not Counter(WORD.findall(r.text)) - Counter(WORD.findall(text[r.doc_id].text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    for s, t in zip(order, mixing.targets([sizes[s] for s in order], [1 + k % 3 for k in range(len(order))])):
        assert abs(taken[s] - t) <= 1.5 * 128
    pieces = seen[4][1]
    assert Counter(p.doc_id for p in pieces if p.start == 0) == Counter(r.doc_id for r in after)


def test_run_on_no_documents(spark, no_docs, tmp_path):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mix_of_repeated_rows(spark):
    rows = [(1, "a b c", "s", 5)] * 3 + [(1, "a b c", None, 5), (2, None, "s", 0), (None, "d e", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    mix = mixing.Mix(docs, block_words=2)
    words = Counter()
    for r in mix.texts(docs).collect():
        words[r.source] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    taken = Counter()
    for r in mix.taken().collect():
        taken[r.source_size] += r.taken
    assert words["s"] == taken[11] and words[None] == taken[3]
    assert secrets.MASK
