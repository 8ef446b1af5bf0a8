"""Reduction on composed texts of fifteen kinds, against the published floors and the kinds that must pass through."""

from skein.plans import fixtures


def test_floors_of_the_generic_chain(spark):
    got = {r["name"]: r["percent"] for r in fixtures.floors(spark).collect()}
    for name, least in (("npm-install", 60), ("pytest-passing", 70), ("docker-pull", 70), ("stacktrace-repeat", 60)):
        assert got[name] >= least, (name, got[name])


def test_whole_way(spark):
    got = {r["name"]: r for r in fixtures.reductions(spark).collect()}
    assert len(got) == 15
    print("\n".join(f"| {n} | {r['bytes_in']} | {r['percent']} | {r['whole_percent']} | {r['rules']} |" for n, r in sorted(got.items())))
    through = {n for n, r in got.items() if r["whole_percent"] == 0}
    # small, dense or failing outputs stay as they are; the six kinds with much to say twice are reduced
    assert through == {"docker-ps", "eslint", "git-diff", "git-status-porcelain", "go-test-json", "npm-test-failing", "pytest-failing", "tsc", "webpack"}
    for name, least in (("npm-install", 90), ("pytest-passing", 90), ("docker-pull", 70), ("stacktrace-repeat", 60), ("git-log", 50), ("cargo-build", 60)):
        assert got[name]["whole_percent"] >= least, (name, got[name]["whole_percent"])
