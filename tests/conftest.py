from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__  # noqa: E402, F401  puts the package on the workers' path

#: Two plain packages, and two that hold a file of the same name.
TESTING = {
    ("lantern", "4.2-7"): ["opt/", "opt/lantern/", "opt/lantern/modes/", *(f"opt/lantern/modes/{m}" for m in ("blink", "dim", "steady")), "usr/", "usr/bin/", "usr/bin/lantern", "usr/bin/lantern-probe"],
    ("Wick", "0.9-1"): ["usr/", "usr/bin/", "usr/bin/wick"],
}
for _flavour in ("amber", "blue"):
    TESTING[f"glass-{_flavour}", "1.0-3" if _flavour == "blue" else "1.0.11-3"] = ["usr/", "usr/share/", f"usr/share/glass-{_flavour}/", f"usr/share/glass-{_flavour}/pane.svg"]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def testing(spark):
    """An index of one small repository."""
    from pathloom.plans.catalog import FileIndex
    from pathloom.plans.manifest import with_names

    rows = [("testing", i, pkg, version, j, f"/{path}") for i, ((pkg, version), paths) in enumerate(TESTING.items()) for j, path in enumerate(paths)]
    manifest = with_names(spark.createDataFrame(rows, "repo string, pkg_ord int, pkg string, version string, file_ord int, path string")).persist()
    return FileIndex.of(manifest)


def archive(path, packages, mode="w:gz", heading="%FILES%"):
    """A tar archive of file lists."""
    import io
    import tarfile

    with tarfile.open(path, mode) as tar:
        for (name, version), paths in packages.items():
            for member, body in (("desc", "ignored\n"), ("files", "\n".join([heading, *paths]) + "\n")):
                info = tarfile.TarInfo(f"{name}-{version}/{member}")
                data = body.encode()
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
