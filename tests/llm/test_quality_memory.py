"""What a fit holds beside its rows, and that its values are those of a table of all of them."""

import tracemalloc

import numpy as np
import pyarrow as pa

from scorelake.llm import quality


def labelled(n, width):
    rng = np.random.default_rng(11)
    y = np.where(np.arange(n) % 3 == 0, -1.0, 1.0)
    return [np.sort(rng.choice(1 << quality.BITS, size=width, replace=False)).astype(np.int32) for _ in range(n)], y


def test_values_are_those_of_a_whole_table():
    rows, y = labelled(40, 300)
    rows.append(np.array([], dtype=np.int32))
    ratio = quality.ratios(rows, np.append(y, 1.0))
    values = quality.Scaled(rows, ratio)
    for r, v in zip(rows, values, strict=True):
        norm = float(ratio[r] @ ratio[r]) ** 0.5
        assert v.dtype == np.float32 and (v == (ratio[r] / (norm or 1.0)).astype(np.float32)).all()


def test_a_fit_holds_no_second_copy_of_its_rows():
    rows, y = labelled(1200, 8000)  # 38 MB of indicators
    tracemalloc.start()
    model = quality.fit_linear(rows, y, 4.0)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 0.6 * sum(r.nbytes for r in rows)
    assert model.margin(rows[1]) > model.margin(rows[0])


def test_views_of_slices_and_empty_values():
    rows = [np.arange(k, dtype=np.int32) for k in (3, 0, 5, 1)]
    for kind in (pa.binary(), pa.large_binary()):
        values = pa.array([r.tobytes() for r in rows], kind)
        for part, want in ((values, rows), (values.slice(1, 3), rows[1:]), (values.slice(4), []), (pa.array([b""], kind), rows[1:2])):
            got = quality.views(part)
            assert len(got) == len(want) and all((a == b).all() and len(a) == len(b) for a, b in zip(got, want))
