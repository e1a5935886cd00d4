"""Random keys of letters of one case or digits alone are reported at any length of a token."""

import numpy as np
import pytest

from quartzgrid.llm import secrets


@pytest.mark.parametrize("letters", [secrets.LOWER, secrets.UPPER, secrets.DIGITS])
def test_short_alphabets(table, letters):
    rng = np.random.default_rng(3)
    sizes = (20, 23) if letters == secrets.DIGITS else (20, 32, 48)  # 24 digits and more are spans of kind hex, too
    keys = [(100 * n + i, f"key {''.join(rng.choice(list(letters), n))} end") for n in sizes for i in range(30)]
    plain = [(9000 + i, f"see {(letters[:2] * 30)[: 32 + i % 4]} here") for i in range(30)]
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secrets.scan_secrets(table(keys + plain)).collect()}
    for n in sizes:
        assert sum(3 in got[100 * n + i] for i in range(30)) >= 26
    assert not any(3 in got[9000 + i] for i in range(30))
