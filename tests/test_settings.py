import pytest

from vigil import settings
from vigil.operators import profile as P
from vigil.plans import datagen
from vigil.sources import wire


def test_settings(tmp_path):
    (tmp_path / "env").write_text("# note\nVIGIL_ROOT='x/y'\nVIGIL_JOB_DAYS = 7\n")
    s = settings.load(str(tmp_path / "env"), {"VIGIL_JOB_DAYS": "9"})
    assert (s.root, s.job_days, s.refresh_days) == ("x/y", 9, 90)
    assert settings.load(str(tmp_path / "none"), {}) == settings.Settings()


def test_retry():
    waited, answers = [], [wire.Unavailable(429), wire.Unavailable(429), "ok"]
    answers[1].retry_after = 9

    def call():
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    assert wire.retrying(call, sleep=waited.append)() == "ok" and waited == [1, 9]
    for errors, tries in (([wire.Unavailable(429)] * 5, 4), ([wire.Unavailable(500)], 1)):
        answers[:] = list(errors)
        with pytest.raises(wire.Unavailable):
            wire.retrying(call, sleep=waited.append)()
        assert len(errors) - len(answers) == tries


def test_tokens():
    now, fetched = [0.0], []

    def fetch(scope):
        fetched.append(scope)
        return f"{scope}{len(fetched)}", now[0] + 1000

    t = wire.Tokens(fetch, lambda: now[0])
    assert t.get("a") == t.get("a") == "a1" and t.get("b") == "b2"
    now[0] = 699
    assert t.get("a") == "a1"
    now[0] = 700
    assert t.headers("a") == {"Authorization": "Bearer a3"}


def test_selection_and_cli(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, n int")
    assert P.selected(df, df.where("k = 'a'"), "k").count() == 2
    with pytest.raises(KeyError):
        P.selected(df, spark.createDataFrame([("c",)], "k string"), "k")
    datagen.main(["--rows", "30", "--out", f"file://{tmp_path}/star"])
    assert spark.read.parquet(f"file://{tmp_path}/star/Ledger").count() == 30 and spark.read.parquet(f"file://{tmp_path}/star/Repayments").count() == 10
