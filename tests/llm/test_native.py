import pytest

from wattle.llm.registry import QUERIES
import wattle.llm.queries  # noqa: F401


@pytest.mark.parametrize("name", ["op2_secret_linking", "op4_entropy_mix"])
def test_no_python_in_native_plans(spark, monkeypatch, name):
    from wattle.llm import entropy_mix, secret_linking
    from wattle.llm.common import materialize

    plans = []

    def seen(df, *how):
        plans.append(df._jdf.queryExecution().toString())
        return materialize(df, *how)

    for module in (entropy_mix, secret_linking):
        monkeypatch.setattr(module, "materialize", seen)
    out = QUERIES[name](spark, "/root/testdata/sf0.001")
    plans.append(out._jdf.queryExecution().toString())
    assert len(plans) > 2
    for plan in plans:
        assert not any(word in plan for word in ("Python", "Pandas", "ArrowEval", "MapInArrow", "CartesianProduct")), plan[:2000]
