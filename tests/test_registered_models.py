import pytest

from assaylens.config import BoostingParams
from assaylens.plans import registry


class _Asked(Exception):
    pass


@pytest.mark.parametrize("name", ["gbt_cv", "tree_attribution", "tree_importance", "tree_local_accuracy", "boosted_persist", "screen_summary"])
def test_boosted_queries_fit_the_configured_model(monkeypatch, name):
    def asked(*args, **kwargs):
        raise _Asked(*[getattr(a, "boosting", a) for a in args])

    for owner, made in ((registry.roles, "design"), (registry.roles, "responses"), (registry.roles, "flags"), (registry.boosting, "boosting_patterns")):
        monkeypatch.setattr(owner, made, lambda *a, **k: None)
    monkeypatch.setattr(registry.boosting, "fit_boosting", asked)
    monkeypatch.setattr(registry.screen, "run_screen", asked)
    with pytest.raises(_Asked) as found:
        registry.Q[name](None, "")
    params = [a for a in found.value.args if isinstance(a, BoostingParams)]
    assert params == [BoostingParams()] and params[0].trees == 200
