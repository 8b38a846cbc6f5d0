"""Signatures are sorted into buckets by parts of a batch: no part is large, and the groups are those of the whole batch."""

from reviewlens.llm import part_enum as pe


def test_parts_are_bounded_and_hold_all_signatures(monkeypatch):
    import numpy as np
    import pyarrow as pa

    class Captured:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            return run

    texts = [" ".join(f"w{(i * 7 + j) % 900}" for j in range(120)) for i in range(60)] + [None, ""] + [" ".join(f"w{j}" for j in range(120))] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])

    def signed(least):
        monkeypatch.setattr(pe, "SIGNED", least)
        monkeypatch.setattr(pe, "SLICE", 200)
        monkeypatch.setattr(pe, "TEXTS", 7)
        parts = list(pe.signature_blocks(Captured(), pe.Join(words=5, least=80, of=100), 8)(iter([batch])))
        pairs = [(b, k, s) for p in parts for b, ks, ss in zip(*(p.column(i).to_pylist() for i in range(3))) if b >= 0
                 for k, s in zip(np.frombuffer(ks, np.int64).tolist(), np.frombuffer(ss, np.uint64).tolist())]
        return parts, sorted(pairs)

    whole, all_pairs = signed(1 << 40)
    parts, pairs = signed(500)
    assert len(whole) == 1 and len(parts) > 5 and pairs == all_pairs and len(pairs) > 5000
    assert max(sum(len(s) for s in p.column(2).to_pylist()) for p in parts) < sum(len(s) for s in whole[0].column(2).to_pylist()) / 4


def test_groups_of_a_bucket_by_parts_equal_the_whole(monkeypatch):
    import numpy as np
    import pyarrow as pa

    class Captured:
        def groupBy(self, *_):
            return self

        def applyInArrow(self, run, schema):
            return run

    r = np.random.default_rng(5)
    sig, key = r.integers(0, 400, 6000).astype(np.uint64), r.integers(-90, 90, 6000)
    hot = np.full(60, 9999, np.uint64), np.arange(60)
    cut = [(key[:3000], sig[:3000]), (key[3000:], sig[3000:]), (hot[1], hot[0])]
    table = pa.table({"bucket": pa.array([3] * 3, pa.int32()), "keys": [k.tobytes() for k, _ in cut], "sigs": [s.tobytes() for _, s in cut]})

    def rows(at_once):
        monkeypatch.setattr(pe, "GROUPED", at_once)
        return sorted(zip(*pe.groups(Captured())(table).to_pydict().values()))

    whole = rows(1 << 40)
    assert {x[0] for x in whole} == {pe.PROPOSED, pe.MEMBER, pe.HOT, pe.HOT_LEADER}
    assert rows(100) == whole and rows(1) == whole
    empty = table.slice(0, 1).set_column(1, "keys", [[b""]]).set_column(2, "sigs", [[b""]])
    assert pe.groups(Captured())(empty).num_rows == 0


def test_tables_of_other_operators_are_dropped(monkeypatch):
    import sys
    import types

    from reviewlens.llm import common

    monkeypatch.setitem(sys.modules, "best_two_fit_worker", types.ModuleType("best_two_fit_worker"))
    common.forget_tables()
    assert "best_two_fit_worker" not in sys.modules
    common.forget_tables()
