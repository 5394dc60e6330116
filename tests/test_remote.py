import time

import pytest
from chunkweave.operators import prompt
from chunkweave.operators.embedding import Remote, embed
from chunkweave.operators.remote import Caller, Pace


class Service:
    """Notes the time of each call in a file that all tasks share."""

    def __init__(self, log):
        self.log = log

    def __call__(self, texts):
        with open(self.log, "a") as f:
            f.write(f"{time.time()}\n")
        time.sleep(0.1)
        return [[float(len(t)), 1.0] for t in texts]

    def most_in(self, seconds):
        at = sorted(map(float, open(self.log)))
        return len(at), max(sum(x <= y < x + seconds for y in at) for x in at)


def test_a_limited_service_rejects_nothing(spark, tmp_path):
    """No half second has more calls than the rate allows, but for the first one of each task; and calls overlap."""
    service = Service(str(tmp_path / "log"))
    rows = spark.range(60).selectExpr("id", "repeat('x', cast(id as int)) as text").repartition(7)
    found = embed(rows, Remote(service, 2), batch=1, pace=Pace(per_second=20, tasks=2, in_flight=4)).collect()
    assert {r.id: r.vector[0] for r in found} == {i: float(i) for i in range(60)} and {r.status for r in found} == {"ok"}
    n, most = service.most_in(0.5)
    assert n == 60 and most <= 20 * 0.5 + 2


def test_answers_keep_the_pace(spark, tmp_path):
    service = Service(str(tmp_path / "log"))

    class Model(prompt.Echo):
        def generate(self, prompts, contexts):
            if prompts[0].endswith("7"):
                raise OSError("no")
            return [f"{service(prompts)[0][0]:.0f}"]

    rows = spark.range(30).selectExpr("id as question_id", "'q' as question", "array(1) as sources", "int(id % 5 > 0) as n_hits", "'c' as context", "concat(repeat('p', 3), id) as prompt")
    got = {r.question_id: r for r in prompt.answers(rows, Model(), Pace(40, tasks=2)).collect()}
    assert len(got) == 30 and got[0].text == prompt.NO_CONTEXT and got[12].text == "5" and got[7].status == "failed" == got[17].status and got[1].sources == [1]
    assert service.most_in(0.5)[1] <= 22


def test_a_service_that_is_down_gets_a_pause():
    now, slept, calls = [0.0], [], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    def service():
        calls.append(now[0])
        if len(calls) <= 4:
            raise OSError("down")
        return "up"

    caller = Caller(Pace(per_second=10, tasks=1, in_flight=1, failures=3, cool=30), lambda: now[0], sleep)
    got = caller.all([lambda: caller.call(service)] * 7)
    assert [isinstance(g, OSError) for g in got] == [True] * 4 + [False] * 3
    assert slept.count(30) == 2  # after the third failure, and after the trial that failed; then it is up
    assert all(b - a >= 0.0999 for a, b in zip(calls[:-1], calls[1:], strict=True))
    with pytest.raises(OSError):
        Caller(Pace(10, failures=9), lambda: now[0], sleep).call(lambda: (_ for _ in ()).throw(OSError("x")))
