"""Settings: YAML files, overridden by TIDEMARK_* environment variables."""

from __future__ import annotations

import os
from pathlib import Path
from typing import Any

import yaml

HERE = Path(__file__).resolve().parents[1] / "config"


def load(folder: str | Path | None = None) -> dict[str, Any]:
    """run.yaml, with `service_map` and `checks` from their own files.

    TIDEMARK_CONFIG_DIR, TIDEMARK_STORAGE_ROOT, TIDEMARK_STATE_ROOT, TIDEMARK_REPOS (by commas),
    TIDEMARK_MAX_PAGES and TIDEMARK_INITIAL_SINCE take precedence.
    """
    env = os.environ
    at = Path(folder or env.get("TIDEMARK_CONFIG_DIR") or HERE)
    out = yaml.safe_load((at / "run.yaml").read_text())
    out["service_map"] = yaml.safe_load((at / "service_map.yaml").read_text())
    out["checks"] = yaml.safe_load((at / "quality.yaml").read_text())
    out["storage_root"] = env.get("TIDEMARK_STORAGE_ROOT", out["storage_root"]).rstrip("/")
    state = f"{out['storage_root']}/_state" if "TIDEMARK_STORAGE_ROOT" in env else out["state_root"]
    out["state_root"] = env.get("TIDEMARK_STATE_ROOT", state).rstrip("/")
    api = out["api"]
    if "TIDEMARK_REPOS" in env:
        api["repos"] = [x.strip() for x in env["TIDEMARK_REPOS"].split(",") if x.strip()]
    api["max_pages"] = int(env.get("TIDEMARK_MAX_PAGES", api["max_pages"]))
    api["initial_since"] = env.get("TIDEMARK_INITIAL_SINCE", api["initial_since"])
    return out
