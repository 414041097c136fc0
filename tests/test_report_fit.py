"""Reports stand on the real discrimination fit, at a size where runs have enough respondents for one."""

import pytest
from compare import compare
from pyspark.sql import functions as F

from sondage.operators import irt
from sondage.plans import report_queries as rq
from sondage.plans.catalog import CHECKS, QUERIES

SF = "/root/testdata/sf0.01"


def test_runs_are_fitted(spark):
    answers, asked = rq.answers_once(spark, SF), rq.v.questions(spark)
    flags = rq.fitted_flags(answers, asked).collect()
    assert flags and all(r["convergence_ok"] for r in flags) and {r["severity"] for r in flags} == {"medium", "high"}


@pytest.mark.parametrize("name", ["question_severity", "report_exposure", "report_findings", "report_card", "observed_classes", "report_sink"])
def test_reports_agree_with_the_sql_of_the_fit(spark, name):
    n, problems = compare(spark, SF, QUERIES[name], CHECKS[name])
    assert n and not problems, problems


def test_proxy_only_without_convergence(spark, monkeypatch):
    whole = irt.fit_discrimination
    monkeypatch.setattr(irt, "fit_discrimination", lambda binary: whole(binary, max_iterations=1))
    flags = rq.severities(spark, SF).where(F.col("irt_severity").isNotNull())
    assert {r["irt_severity"] for r in flags.collect()} == {"none"}
