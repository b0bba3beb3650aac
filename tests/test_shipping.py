"""Python stages must load on workers that do not have this package on their path."""

import subprocess
import sys

import pytest
from pyspark import cloudpickle

from feedops.operators import anchors, extract
from feedops.sources import blobs


CALLS = [
    (extract._listing_rows, ("<table><tr class='ub-content'></table>", {"t": extract.TABLE_ROWS}, False)), (extract._first_tags, ("", "a", ("b",))),
    (extract._body_tags, ("", "a", "b", "img")), (anchors._composed, None), (anchors._chunk_function, None)]


@pytest.mark.parametrize("call", CALLS, ids=[c[0].__name__ for c in CALLS])
def test_stage_code_travels_by_value(call, tmp_path):
    path = tmp_path / "stage"
    path.write_bytes(cloudpickle.dumps(call))
    code = f"import pickle; f, args = pickle.load(open({str(path)!r}, 'rb')); args is None or f(*args)"
    subprocess.run([sys.executable, "-c", code], cwd="/", check=True, timeout=60)


def test_line_digests_travel_by_value(tmp_path):
    test_stage_code_travels_by_value((blobs._line_digests, None), tmp_path)
