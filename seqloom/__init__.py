"""seqloom: interpretable sequence and group-comparison analytics on Spark."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path


def ship(spark) -> None:
    """Send this package to the session's Python workers, once a session: they need not run where it is installed."""
    sc, here = spark.sparkContext, Path(__file__).resolve().parent
    if any(name.startswith("seqloom-") for name in sc._python_includes):
        return
    out = Path(tempfile.mkdtemp(prefix="seqloom-")) / f"seqloom-{sc.applicationId}.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(here.rglob("*.py")):
            z.write(path, path.relative_to(here.parent))
    sc.addPyFile(str(out))
