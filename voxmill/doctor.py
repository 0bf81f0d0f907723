"""What this machine offers: versions, tools and modules."""

from __future__ import annotations

import importlib.metadata
import os
import platform
import shutil

#: Modules that parts of the library need, and tools.
MODULES, TOOLS = ("pyspark", "pyarrow", "pandas", "numpy", "tiktoken"), ("java", "ffmpeg", "ffprobe")


def capabilities() -> dict[str, str | None]:
    """The version of each module, the place of each tool, None where it is missing; memory and cores."""
    found: dict[str, str | None] = {"python": platform.python_version()}
    for m in MODULES:
        try:
            found[m] = importlib.metadata.version(m)
        except importlib.metadata.PackageNotFoundError:
            found[m] = None
    found |= {t: shutil.which(t) for t in TOOLS}
    memory = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") if hasattr(os, "sysconf") else 0
    return found | {"cores": str(os.cpu_count()), "memory_gb": f"{memory / 2**30:.1f}"}


def report() -> str:
    return "\n".join(f"{k}: {v or 'missing'}" for k, v in capabilities().items())


if __name__ == "__main__":
    print(report())
