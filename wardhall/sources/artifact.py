"""Build and migration artifacts: a zip with metadata and the plan's steps, reviewed before it is applied."""

from __future__ import annotations

import datetime as dt
import json
import os
import shutil
import zipfile

from ..model import GovernanceError

MEMBERS = ("metadata.json", "plan.json")


def write(folder: str, kind: str, profile: str, metadata: dict, plan: list[dict], now: dt.datetime) -> str:
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{profile}_{kind}_{now.strftime('%Y%m%dT%H%M%S%f')}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, value in zip(MEMBERS, (metadata, plan), strict=True):
            z.writestr(name, json.dumps(value, indent=1, sort_keys=True, default=str))
    return path


def read(path: str) -> tuple[dict, list[dict]]:
    """(metadata, plan); a file that isn't a whole artifact raises."""
    try:
        with zipfile.ZipFile(path) as z:
            if missing := set(MEMBERS) - set(z.namelist()):
                raise GovernanceError(f"{path} lacks {', '.join(sorted(missing))}")
            return tuple(json.loads(z.read(m)) for m in MEMBERS)  # type: ignore[return-value]
    except (zipfile.BadZipFile, FileNotFoundError, json.JSONDecodeError) as e:
        raise GovernanceError(f"{path} is no artifact: {e}") from None


def latest(folder: str, profile: str) -> str | None:
    """The newest artifact of a profile by the time in its name, builds and migrations alike."""
    names = [n for n in (os.listdir(folder) if os.path.isdir(folder) else []) if n.startswith((f"{profile}_build_", f"{profile}_migrate_")) and n.endswith(".zip")]
    return os.path.join(folder, max(names, key=lambda n: n.rpartition("_")[2])) if names else None


def purge(folder: str, confirmed: bool) -> bool:
    """Removes an output folder, if that was confirmed."""
    if not confirmed or not os.path.isdir(folder):
        return False
    shutil.rmtree(folder)
    return True
