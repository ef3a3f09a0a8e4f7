from pyspark.sql import Row

from gleanery.streaming import content


class _State:
    def __init__(self):
        self.value, self.calls = None, []

    def get(self):
        self.calls.append("get")
        return self.value

    def exists(self):
        self.calls.append("exists")
        return self.value is not None

    def update(self, value):
        self.calls.append("update")
        self.value = value


def test_state_is_asked_once_and_the_least_place_of_a_batch_wins():
    processor = content._FirstWins(None)
    processor.first = _State()
    rows = (Row(name=str(n), place=n) for n in range(25_000, 0, -1))
    got = list(processor.handleInputRows(("h",), rows, None))
    assert [r.name for r in got if r.outcome == content.ACCEPTED] == ["1"] and {r.first for r in got} == {"1"} and len(got) == 25_000
    assert processor.first.calls == ["get", "update"]
    again = list(processor.handleInputRows(("h",), iter([Row(name="x", place=0)]), None))
    assert [(r.outcome, r.first) for r in again] == [(content.DUPLICATE, "1")] and processor.first.calls == ["get", "update", "get"]
