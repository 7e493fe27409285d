import pyarrow as pa
import pytest

from treegauge.operators import user_analyzers
from treegauge.operators.user_analyzers import run_user_analyzers, user_entries, user_errors
from treegauge.specs import PythonAnalyzer, ScanRules, StackRule

RULES = ScanRules((StackRule("All", ("txt",), ("size",)),))
CHANGE = ("scan_id long, scan_mode string, file_path string, change_type string, old_file_path string, tech_stack string, "
          "content string, old_content string")


def analyzer():
    def size(file_path, content, change_type):  # local, so that it is pickled by value
        if "bad" in content:
            raise ValueError("bad text")
        return [{"value": len(content), "tags": {"metric": "size"}}]

    return PythonAnalyzer("size", func=size)


@pytest.mark.parametrize("files, chars, lengths", [(3, 1 << 20, [3, 3, 3, 1]), (256, 1, [1] * 10), (256, 1 << 20, [10])])
def test_results_of_a_batch_leave_in_slices(spark, monkeypatch, files, chars, lengths):
    monkeypatch.setattr(user_analyzers, "SLICE_FILES", files)
    monkeypatch.setattr(user_analyzers, "SLICE_CHARS", chars)
    run = user_analyzers._runner([analyzer()]).func
    names, texts = [f"f{i}.txt" for i in range(10)], ["x" * i for i in range(10)]
    none = pa.nulls(10, pa.string())
    batch = (pa.array(names), pa.array(names), none, pa.array(texts), pa.array(["A"] * 10), pa.array([[0]] * 10, pa.list_(pa.int32())))
    parts = list(run(iter([batch])))
    assert [len(p) for p in parts] == lengths
    found = [r for p in parts for r in p.to_pylist()]
    assert [[(r["number"], r["side"], r["error"]) for r in rs] for rs in found] == [[(0, "after", None)]] * 10


def test_slices_stay_with_their_files(spark, monkeypatch):
    monkeypatch.setattr(user_analyzers, "SLICE_FILES", 3)
    rows = [(1, "DIFF", f"f{i}.txt", "M", None, "All" if i % 4 else None, None if i % 5 == 0 else "y" * i + ("bad" if i % 7 == 0 else ""),
             "z" * (2 * i)) for i in range(40)]
    results = run_user_analyzers(spark.createDataFrame(rows, CHANGE).coalesce(1), [analyzer()], RULES)
    got = {(r.file_path, r.side): r.value for r in user_entries(results).collect()}
    errors = {(r.side, r.error) for r in user_errors(results).collect()}
    want, failed = {}, set()
    for _, _, path, _, _, stack, new, old in rows:
        for side, text in (("before", old), ("after", new)):
            if stack and text is not None:
                if "bad" in text:
                    failed.add((side, f"{path}: bad text"))
                else:
                    want[path, side] = float(len(text))
    assert got == want and errors == failed
