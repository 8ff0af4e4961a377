from tabloom.llm.common import held


def test_a_worker_holds_the_tables_of_one_operator():
    made = []
    one = held("one", lambda: made.append("one") or object())
    assert held("one", lambda: made.append("again") or object()) is one
    two = held("two", lambda: made.append("two") or object())
    assert two is held("two", list) and made == ["one", "two"]
    assert held("one", list) == []
