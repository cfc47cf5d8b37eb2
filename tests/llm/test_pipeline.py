"""run() against the stages' own rules in plain Python."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from itertools import combinations
from pathlib import Path

import corpus_pipeline
import numpy as np
from floodplain.llm import decontam, langid
from floodplain.llm.queries import WEIGHTS
from floodplain.llm.state import written
from test_operators import WORD, brute_components, brute_lines, filled, plain

SF = Path("/root/testdata/sf0.001")


def contest(langs, margins, first):
    """(winner, least margin) by votes, then sums, then the later name."""
    if len(langs) == 1:
        return langs[0], None
    own = {x: [] for x in langs}
    for j, (a, b) in enumerate(combinations(langs, 2), first):
        own[a].append(margins[j])
        own[b].append(-margins[j])
    best = max(langs, key=lambda x: (sum(m > 0 for m in own[x]), sum(own[x]), langs.index(x)))
    return best, min(own[best])


def slowly_predicted(model, text):
    """A text's language and score, one text and one machine at a time."""
    if not text or not re.search(r"[^\W\d_]", text):
        return "und", 0.0
    margins = langid.features(np.frombuffer(text.encode(), np.uint8)) @ model.table.astype(np.float64)
    score = lambda m: 1.0 if m is None else 1 / (1 + np.exp(-langid.SLOPE * m))
    family, one = contest(list(model.families.names), margins, model.families.first)
    inner = model.inside[model.families.names.index(family)]
    lang, two = contest(list(inner.names), margins, inner.first)
    return lang, score(one) * score(two)


def least_edits(item, text):
    """The least edit distance of an item to a stretch of the text, one row of the table at a time."""
    item, text = np.array([ord(c) for c in item]), np.array([ord(c) for c in text])
    columns = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, c in enumerate(item.tolist(), 1):
        new = np.r_[i, np.minimum(row[:-1] + (text != c), row[1:] + 1)]
        row = np.minimum.accumulate(new - columns) + columns
    return int(row.min())


def slowly_cleaned(rows, items):
    held = [p for p in (plain(t) for t in items) if len(p) >= decontam.MIN_CHARS]
    budget = lambda p: min(len(p) // 10, (len(p) - decontam.Q) // decontam.Q)
    return {i for i, t in rows if not any(least_edits(p, plain(t)) <= budget(p) for p in held)}


def slowly_mixed(rows, share=0.5, max_epochs=2, seed=17):
    domain = lambda s: "other" if not s or not s[-1].isdigit() else "web" if int(s[-1]) % 2 == 0 else "books"
    own = [((domain(r.source), r.lang or "none", r.source or "none"), r.doc_id, n) for r in rows if r.doc_id is not None and (n := len(WORD.findall(r.text or "")))]
    leaves = Counter()
    for leaf, _, n in own:
        leaves[leaf] += n
    out = set()
    for leaf, budget in filled(leaves, WEIGHTS, float(round(share * sum(leaves.values()))), max_epochs).items():
        used = 0
        for epoch in range(max_epochs):
            for _, i, n in sorted((hashlib.md5(f"{seed}:{epoch}:{i}".encode()).hexdigest(), i, n) for x, i, n in own if x == leaf):
                if used < budget:
                    out.add((i, epoch, n))
                used += n
    return out


def test_run_and_each_stage_against_plain_python(spark):
    first = docs = spark.read.parquet(str(SF / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.collect()
        before = {r.doc_id: r for r in rows}
        out = written(stage(spark, docs, str(SF)), name)
        found = out.collect()
        after = {r.doc_id: r for r in found}
        assert set(after) <= set(before)
        if name != "source_mixing":
            assert out.schema.names == docs.schema.names and out.dtypes == docs.dtypes
        if name == "language_id":
            model = langid.train(docs.where(~langid.held_out()))
            said = {i: slowly_predicted(model, r.text) for i, r in before.items()}
            assert set(after) == {i for i, (lang, score) in said.items() if lang != "und" and score >= corpus_pipeline.MIN_SCORE}
            assert all(after[i].lang == (before[i].lang or said[i][0]) for i in after)
        if name == "line_dedup":
            exp = brute_lines([(i, r.text) for i, r in before.items()])
            assert all(hashlib.sha256((after[i].text or "").encode()).hexdigest() == digest and after[i].n_chars == len(after[i].text) for i, (_, _, digest) in exp.items())
        if name == "near_dedup":
            exp = brute_components([(i, r.text) for i, r in before.items()], corpus_pipeline.SIMILAR_PERCENT)
            assert set(after) == {i for i, (_, _, kept) in exp.items() if kept}
        if name == "decontamination":
            items = [r.text for r in spark.read.parquet(str(SF / "benchmark.parquet")).collect()]
            assert set(after) == slowly_cleaned([(r.doc_id, r.text) for r in rows], items) < set(before)
        if name == "source_mixing":
            assert {(r.doc_id, r.epoch, r.n_tokens) for r in found} == slowly_mixed(rows)
            assert all((r.text, r.lang, r.source) == (before[r.doc_id].text, before[r.doc_id].lang, before[r.doc_id].source) for r in found)
        docs = out
    whole = corpus_pipeline.run(spark, str(SF)).collect()
    assert sorted(map(str, whole)) == sorted(map(str, found)) and len(whole) < 2 * first.count()


def test_stages_do_not_crash_on_odd_rows(spark):
    rows = [(1, None, "en", "src1", 0, 9), (2, "", None, None, 0, 9), (2, "the of and " * 30, "en", "src1", 3, 9), (None, "le la les et " * 30, "fr", "src2", 3, 9), (5, "x" * 200_000, None, "src1", None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _kept int")
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, str(SF)), name)
        written(stage(spark, docs.limit(0), str(SF)), name).count()
        if name != "source_mixing":
            assert out.columns == docs.columns
        docs = out
