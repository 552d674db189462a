import json

import pytest

from winnower.plans import config


def test_layers(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"privacy": {"whitelist": ["a@b.org"]}, "other": {"x": 1}}))
    got = config.load(str(path), {"WINNOWER_PRIVACY__BLOCK_MIN_SCORE": "70", "WINNOWER_WAF__BLOCK_MODE": "yes", "HOME": "/"})
    assert got["privacy"]["whitelist"] == ["a@b.org"] and got["privacy"]["block_min_score"] == 70 and got["waf"]["block_mode"] is True
    assert got["compression"] == config.DEFAULTS["compression"] and got["other"] == {"x": 1}
    assert config.load(str(tmp_path / "none.json"), {}) == config.DEFAULTS


@pytest.mark.parametrize("wrong", [{"privacy": 3}, {"loop_guard": {"window": "ten"}}, {"compression": {"level": "hard"}}, {"waf": {"enabled": 1}}])
def test_wrong_values(tmp_path, wrong):
    path = tmp_path / "c.json"
    path.write_text(json.dumps(wrong))
    with pytest.raises(ValueError):
        config.load(str(path), {})
