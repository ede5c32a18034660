"""Documents of several drafts: sections, sizes and budgets read back, odd entries."""

import re

from sedimark.operators.builders import multi_draft_documents


def test_documents(spark):
    entries = [("a", ["ALA"] * 30, [0, 8, 8, 0, 2, 20, 1, 3, 5, 40]), ("b", ["GLY"] * 30, [k for i in range(20) for k in (i, i + 7)]), ("c", ["ALA"] * 200, [0, 9]), ("d", [], []), ("e", ["ALA"] * 9, None), (None, ["ALA"], [])]
    rollouts = [(e, k, [x for i in range(4 + k) for x in (i, i + 9)], 0.1 * k) for e in "abce" for k in range(8)] + [("a", 50, [1, 2], 0.9), ("a", 51, None, 0.9), ("zz", 0, [0, 9], 0.5)]
    e = spark.createDataFrame(entries, "entry_id string, residues array<string>, pairs array<int>")
    r = spark.createDataFrame(rollouts, "entry_id string, rollout int, pairs array<int>, f1 double")
    out = {d.entry_id: d for d in multi_draft_documents(e, r, 150, 0.5).collect()}
    assert {d.entry_id: d.document for d in multi_draft_documents(e.repartition(4), r.repartition(5), 150, 0.5).collect()} == {k: d.document for k, d in out.items()}
    assert set(out) == {"a", "b", "e", None}
    for k, d in out.items():
        tokens = d.document.split(" ")
        assert len(tokens) == d.n_tokens <= 150 and tokens[-1] == "<end>"
        first = re.search(r"<p(\d+)> <(?:ALA|GLY)>", d.document)
        start = int(first.group(1))
        sections = d.document.split("<begin_statements>")[1:]
        pairs = [sorted(tuple(sorted((int(x) - start) % 2000 for x in m)) for m in re.findall(r"<contact> <p(\d+)> <p(\d+)>", s)) for s in sections]
        assert len(pairs) == d.n_drafts + 1 and len(pairs[-1]) == d.n_true
        allowed = [{(i, i + 9) for i in range(4 + j)} for j in range(8)]
        assert all(p and any(set(p) <= a for a in allowed) and len(set(p)) == len(p) for p in pairs[:-1])
        true = {"a": {(0, 8), (2, 20)}, "b": {(i, i + 7) for i in range(20)}}.get(k, set())
        assert set(pairs[-1]) <= true and (len(pairs[-1]) == len(true) or d.n_tokens > 147)
        assert (d.mean_f1 is None) == (d.n_drafts == 0)
    assert out["a"].n_drafts > 0 and out["e"].n_drafts == 0 and out["b"].n_true == 20
    tight = {d.entry_id: d for d in multi_draft_documents(e, r, 80, 0.5).collect()}
    assert tight["b"].n_true == (80 - 64) // 3 and tight["b"].n_drafts == 0
    assert multi_draft_documents(e.limit(0), r, 80, 0.5).count() == 0
