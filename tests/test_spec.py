import pytest

from canopy.errors import ConfigurationError
from canopy.spec import Agg, Filter, NodeBounds


def test_bounds():
    a, b = NodeBounds(1, 10, 0), NodeBounds(2, 7, 1)
    assert (a.height, a.contains(b), b.contains(a), a.depth_delta(b)) == (10, True, False, 1)


@pytest.mark.parametrize("make", [
    lambda: Agg.percentile("x", 1.5), lambda: Agg.top_k("x", 0), lambda: Agg.string_agg("x", limit=0), lambda: Agg.json_agg([]),
    lambda: Filter.of({}), lambda: Filter.of({"a": [1]}), lambda: Agg.string_agg("x", order_by="y").distinct(), lambda: Agg.sum("x").distinct(),
    lambda: Agg.median("x").as_lazy(), lambda: Agg.sum("x").alias,
])
def test_refused(make):
    with pytest.raises(ConfigurationError):
        make()
