import pytest

from pathloom.functions.patterns import PatternError
from pathloom.operators import listing, search
from pathloom.options import Match, Options, list_target, path_bins
from pathloom.plans import render

from .conftest import TESTING

BINS = ("/bin/", "/usr/bin/")
GLOB, REGEX = Match.GLOB, Match.REGEX
MODES = "/opt/lantern/modes/"


def shown(index, target, mode="search", **options):
    o = Options(bins=BINS, **options)
    found = search.search(index, target, o) if mode == "search" else listing.list_files(index, target, o)
    return "".join(render.printed(found, o.raw, o.eol))


GLASS = "testing/glass-amber\ntesting/glass-blue\n"
LANTERN, WICK = "testing/lantern\n", "testing/Wick\n"


@pytest.mark.parametrize(
    ("target", "options", "expected"),
    [
        # a basename, a path, and what both print with versions
        ("pane.svg", {}, GLASS),
        (f"{MODES}dim", {}, LANTERN),
        ("pane.svg", {"verbose": True}, "testing/glass-amber 1.0.11-3\t/usr/share/glass-amber/pane.svg\ntesting/glass-blue 1.0-3    \t/usr/share/glass-blue/pane.svg\n"),
        ("unheard-of", {}, ""),
        # patterns
        (f"{MODES}?[il]*", {"match": GLOB}, LANTERN),
        (f"{MODES}*", {"match": GLOB, "verbose": True}, "".join(f"testing/lantern 4.2-7\t{MODES}{m}\n" for m in ("blink", "dim", "steady"))),
        ("PROBE$", {"ignore_case": True, "match": REGEX}, LANTERN),
        # directories only where asked for, and only with their slash
        (MODES, {}, ""),
        (MODES, {"directories": True}, LANTERN),
        (MODES[:-1], {"directories": True}, ""),
        ("bin", {"directories": True}, WICK + LANTERN),
        ("/", {"directories": True}, ""),
        ("//", {"directories": True}, ""),
        # case
        ("WICK", {}, ""),
        ("WICK", {"ignore_case": True}, WICK),
        ("/OPT/lantern/MODES/dim", {"ignore_case": True}, LANTERN),
        ("/OPT/lamp/MODES/dim", {"ignore_case": True}, ""),
        (MODES.upper(), {"ignore_case": True}, ""),
        (MODES.upper(), {"ignore_case": True, "directories": True}, LANTERN),
        # a path without its first slash is none
        ("usr/bin/wick", {}, ""),
        # output
        ("lantern", {"quiet": True}, "lantern\n"),
        ("lantern", {"quiet": True, "verbose": True, "binaries": True}, "testing/lantern 4.2-7\t/usr/bin/lantern\n"),
        ("wick", {"eol": "\0"}, "testing/Wick\0"),
        # restrictions
        ("lantern", {"binaries": True, "directories": True}, LANTERN),
        ("dim", {"binaries": True}, ""),
        ("wick", {"repo": "testing"}, WICK),
        ("wick", {"repo": "elsewhere"}, ""),
    ],
)
def test_search(testing, target, options, expected):
    assert shown(testing, target, **options) == expected


def entries(pkg, quiet=False, width=0):
    paths = next(v for (name, _), v in TESTING.items() if name == pkg)
    return "".join(f"/{p}\n" if quiet else f"{f'testing/{pkg}'.ljust(width)}\t/{p}\n" for p in sorted(paths))


@pytest.mark.parametrize(
    ("target", "options", "expected"),
    [
        ("lantern", {}, entries("lantern")),
        ("lantern", {"directories": True, "verbose": True}, entries("lantern")),
        ("^glass-.*e", {"match": REGEX}, entries("glass-amber") + entries("glass-blue", width=19)),
        ("lass-.*", {"match": REGEX, "raw": True}, entries("glass-amber") + entries("glass-blue")),
        ("glass-*", {"match": GLOB}, entries("glass-amber") + entries("glass-blue", width=19)),
        ("lantern", {"binaries": True}, "".join(f"testing/lantern\t/usr/bin/{b}\n" for b in ("lantern", "lantern-probe"))),
        ("glass-blue", {"quiet": True}, entries("glass-blue", quiet=True)),
        ("testing/glass-blue", {}, entries("glass-blue")),
        ("testing/glass-blue", {"repo": "elsewhere"}, entries("glass-blue")),
        ("wick", {"ignore_case": True}, entries("Wick")),
        ("wick", {}, ""),
        ("/usr/bin", {}, ""),
    ],
)
def test_list(testing, target, options, expected):
    assert shown(testing, target, "list", **options) == expected


def test_bad_pattern(testing):
    with pytest.raises(PatternError):
        search.search(testing, "*invalid", Options(match=REGEX))


def test_order_of_repositories(spark):
    """A search goes by repository, a listing by the whole name: - sorts before /."""
    from pathloom.plans.catalog import FileIndex
    from pathloom.plans.manifest import with_names

    rows = [(repo, n, "x", "1-1", 0, "/usr/x") for n, repo in enumerate(("core", "core-testing"))]
    index = FileIndex.of(with_names(spark.createDataFrame(rows, "repo string, pkg_ord int, pkg string, version string, file_ord int, path string")))
    assert shown(index, "x") == "core/x\ncore-testing/x\n"
    assert shown(index, "x", "list") == "core-testing/x\t/usr/x\ncore/x        \t/usr/x\n"


def test_dedupe_is_by_package_not_name(spark):
    from pathloom.plans.catalog import FileIndex
    from pathloom.plans.manifest import with_names

    rows = [("r", n, "same", "1-1", f, "/usr/x") for n in (0, 1) for f in (0, 1)]
    index = FileIndex.of(with_names(spark.createDataFrame(rows, "repo string, pkg_ord int, pkg string, version string, file_ord int, path string")))
    assert shown(index, "x") == "r/same\n" * 2
    assert shown(index, "/usr/x") == "r/same\n" * 4
    assert shown(index, "same", "list") == "r/same\t/usr/x\n" * 2


def test_targets_and_bins(tmp_path):
    assert list_target("core/bash") == ("core", "bash")
    assert list_target("/usr/bin", "core") == ("core", "/usr/bin")
    (tmp_path / "real").mkdir()
    (tmp_path / "link").symlink_to(tmp_path / "real")
    assert path_bins(f"{tmp_path}/link:relative::/home/me/bin:{tmp_path}/real") == (f"{tmp_path}/real/",)
    assert path_bins(None) == ()


def test_pushdown(spark, tmp_path):
    """Basenames and literal beginnings of globs reach the scan; repositories prune partitions."""
    from pathloom.plans.catalog import FileIndex, write_repos, write_version
    from pathloom.plans.manifest import with_names

    rows = [("r", 0, "a", "1-1", 0, "/usr/bin/a")]
    write_repos(with_names(spark.createDataFrame(rows, "repo string, pkg_ord int, pkg string, version string, file_ord int, path string")), str(tmp_path))
    write_version(spark, str(tmp_path))
    index = FileIndex.open(spark, str(tmp_path))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(basename,a)" in plan(search.search(index, "a"))
    listed = plan(listing.list_files(index, "a"))  # the package has been looked up, and its name and number reach the one scan
    assert "EqualTo(pkg,a)" in listed and "EqualTo(pkg_ord,0)" in listed and "Join" not in listed
    assert "StringStartsWith(path,/usr/bin/)" in plan(search.search(index, "/usr/bin/*", Options(match=GLOB)))
    assert "isnotnull(repo" in plan(search.search(index, "a", Options(repo="r"))).split("PartitionFilters")[1].split("PushedFilters")[0]
