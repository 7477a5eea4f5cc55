import weakref

from pairloom.llm import batches


class Table(list):
    pass


def test_memory_is_given_back_once_a_task_holds_nothing(monkeypatch):
    tables, alive = [], []
    monkeypatch.setattr(batches, "release", lambda: alive.append(tables[0]() is not None))

    def run(given):
        table = Table()
        tables.append(weakref.ref(table))
        for batch in given:
            table.append(batch)
            yield len(table)

    assert list(batches.settled(run)(iter("ab"))) == [1, 2]
    assert alive == [False]
