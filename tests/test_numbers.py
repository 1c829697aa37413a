"""Special functions against closed forms and published values."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veristrata.functions import canonical, ed25519, stats


def test_beta():
    assert stats.beta_cdf(0.3, 1, 1) == pytest.approx(0.3)
    assert stats.beta_cdf(0.4, 2, 3) == pytest.approx(sum(math.comb(4, k) * 0.4**k * 0.6 ** (4 - k) for k in range(2, 5)))
    assert stats.beta_quantile(stats.beta_cdf(0.77, 5, 2), 5, 2) == pytest.approx(0.77)


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 60), st.floats(0.01, 0.99))
def test_binomial_tail(n, p):
    k = n // 2
    assert stats.binomial_tail(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)), rel=1e-9)


def test_chi_square():
    assert stats.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert stats.chi_square_tail(4.0, 2) == pytest.approx(math.exp(-2))
    assert stats.chi_square_tail_inverse(0.05, 1) == pytest.approx(3.841458820694124)


def test_fisher():
    # Fisher's tea table
    assert stats.fisher_greater(3, 1, 1, 3) == pytest.approx(17 / 70)


def test_ks_exact_against_enumeration():
    from itertools import combinations

    n, m = 4, 5
    seen = []
    for choice in combinations(range(n + m), n):
        i = j = d = 0
        for k in range(n + m):
            i, j = (i + 1, j) if k in choice else (i, j + 1)
            d = max(d, abs(i / n - j / m))
        seen.append(d)
    for statistic in sorted(set(seen)):
        p, method = stats.ks_p_value(statistic, n, m)
        assert method == "exact"
        assert p == pytest.approx(np.mean([s >= statistic - 1e-12 for s in seen]))


def test_ks_asymptotic():
    assert stats.kolmogorov_tail(1.3580986) == pytest.approx(0.05, abs=1e-4)
    assert stats.ks_p_value(0.05, 20_000, 20_000)[1] == "asymptotic"


def test_intervals():
    low, high = stats.wilson(8, 10)
    assert (round(low, 4), round(high, 4)) == (0.4902, 0.9433)
    assert stats.jeffreys_upper(5, 5) == 1.0
    assert stats.mcnemar_exact(0, 0) == 1.0
    assert stats.mcnemar_exact(1, 5) == pytest.approx(2 * 7 / 64)
    assert stats.required_n(0.5, 0.6) == stats.required_n(0.6, 0.5) == 388  # with the pooled share where there is no difference


def test_permutations_repeat():
    assert 0 < stats.psi_permutation_p([5, 5], [5, 6], 200) <= 1


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.booleans()), min_size=1, max_size=40))
def test_isotonic_levels_rise(rows):
    edges, levels = stats.pool_adjacent([r[0] for r in rows], [float(r[1]) for r in rows])
    assert levels == sorted(levels) and edges == sorted(edges)


def test_ed25519_rfc8032():
    # RFC 8032, section 7.1, tests 1 and 2
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    key = bytes.fromhex("d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a")
    signature = bytes.fromhex("e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b")
    assert ed25519.public_key(seed) == key
    assert ed25519.sign(seed, b"") == signature
    assert ed25519.verify(key, b"", signature)
    assert not ed25519.verify(key, b"x", signature)


def test_canonical():
    assert canonical.encode({"b": 1, "a": [True, None, "é"]}) == '{"a":[true,null,"é"],"b":1}'.encode()
    assert canonical.parse(b'{"a":1}') == {"a": 1}
    for bad in (b'{"a":1,"a":2}', b'{"b":1,"a":2}', b'{"a": 1}', b'{"a":1.5}', b'{"a":9007199254740992}'):
        with pytest.raises(ValueError):
            canonical.parse(bad)
    assert canonical.percent_decode(canonical.percent_encode("a%é b")) == "a%é b"
