"""Golden cases of the record engine on tiny datasets, and swap-pop against a list model."""

import random

import pytest

from recordloom.errors import BadOption, MissingEngine, NonUniqueKey
from recordloom.plans.engines import Facade, FilterEngine, SearchEngine, SortEngine
from recordloom.sources.store import Store, swap_pop

USERS = [(1, "Vasyl", "Kyiv", 25), (2, "Vlad", "Lviv", 30), (3, "Ivan", "Kyiv", 30), (4, "Oleh", "Odesa", 20), (5, "Viktor", "Lviv", 35)]
SCHEMA = "id int, name string, city string, age int"


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame(USERS, SCHEMA)


def ids(result):
    return [r.id for r in result.collect()]


def test_filter(users):
    f = FilterEngine(users, keys=["id"])
    assert ids(f.filter([{"field": "city", "values": ["Kyiv", "Lviv"]}, {"field": "age", "values": [30]}])) == [2, 3]
    assert ids(f.filter([{"field": "id", "exclude": [1, 3]}])) == [2, 4, 5]
    assert ids(f.filter([{"field": "age", "values": ["30", True]}])) == []
    assert ids(f.filter([{"field": "age"}])) == [1, 2, 3, 4, 5]
    assert ids(f.filter([{"field": "age", "values": []}])) == []


def test_filter_sequences(users):
    f = FilterEngine(users, fields=["id"], keys=["id"], filter_by_previous_result=True)
    city = lambda *v: {"field": "city", "values": list(v)}
    age = lambda *v: {"field": "age", "values": list(v)}
    assert ids(f.filter([city("Kyiv")])) == [1, 3]
    assert ids(f.filter([city("Kyiv", "Lviv")])) == []
    f.reset_filter_state()
    assert [ids(f.filter([city("Lviv"), age(*a)])) for a in ([30], [30, 35], [30, 35, 25], [30, 35], [30])] == [[2], [], [], [], [2]]
    f.reset_filter_state()
    assert [ids(f.filter([{"field": "id", "exclude": x}])) for x in ([1, 4], [1, 4, 5], [1, 4])] == [[2, 3, 5], [2, 3], [2, 3, 5]]


def test_nested(spark):
    rows = [("a", [("1", "pending"), ("2", "delivered")]), ("b", [("3", "delivered")]), ("c", []), ("d", None)]
    data = spark.createDataFrame(rows, "id string, orders array<struct<id string, status string>>")
    f = FilterEngine(data, nested_fields=["orders.status"], keys=["id"])
    assert ids(f.filter([{"field": "orders.status", "values": ["delivered"]}])) == ["a", "b"]
    assert ids(f.filter([{"field": "orders.status", "exclude": ["pending"]}])) == ["b", "c", "d"]
    s = SearchEngine(data, nested_fields=["orders.status"], keys=["id"], silent=True)
    assert ids(s.search("orders.status", "PEND")) == ["a"]
    assert ids(s.search("orders.status", "pendingdelivered")) == []


def test_search(spark):
    rows = [(1, "John", "Boston"), (2, "Johnny", "Joplin"), (3, "Jo", "Kyiv"), (4, "Ann", "Johnstown")]
    data = spark.createDataFrame(rows, "id int, name string, city string")
    s = SearchEngine(data, fields=["name", "city"], keys=["id"], silent=True)
    assert ids(s.search("jo")) == [1, 2, 3, 4]
    assert ids(s.search("jo", offset=1, limit=1)) == [2]
    assert ids(s.search("name", " JOH ")) == [1, 2]
    assert ids(s.search("  ")) == [1, 2, 3, 4] and ids(s.search("jo", limit=0)) == []
    assert ids(s.search("nothing", "jo")) == []
    assert s.stats()["total"] == 3
    n = SearchEngine(data, fields=["name", "city"], keys=["id"], filter_by_previous_result=True, silent=True)
    assert ids(n.search("name", "jo")) == [1, 2, 3] and ids(n.search("city", "joh")) == []


def test_sort(users, spark):
    s = SortEngine(users, keys=["id"])
    assert ids(s.sort([{"field": "age"}])) == [4, 1, 2, 3, 5]
    assert ids(s.sort([{"field": "age", "direction": "desc"}])) == [5, 3, 2, 1, 4]
    assert ids(s.sort([{"field": "city", "direction": "desc"}, {"field": "age"}])) == [4, 2, 5, 1, 3]
    nulls = spark.createDataFrame([(1, None), (2, 5), (3, 0), (4, 1)], "id int, value int")
    assert ids(SortEngine(nulls, keys=["id"]).sort([{"field": "value"}])) == [1, 3, 4, 2]


def test_mutations(users):
    store = Store(users, ["id"])
    seen = []
    stop = store.subscribe(lambda e: seen.append(e["type"]))
    store.delete("id", 1)
    assert [r.id for r in store.rows().collect()] == [5, 2, 3, 4]
    store.add([{"id": 10, "name": "New", "city": "Kyiv", "age": 20}])
    store.add([])
    store.update("id", {"id": 2, "name": "Changed", "city": "Lviv", "age": 1})
    store.update("id", {"id": 77, "name": "Nobody", "city": None, "age": 1})
    assert [(r.id, r.name) for r in store.rows().collect()] == [(5, "Viktor"), (2, "Changed"), (3, "Ivan"), (4, "Oleh"), (10, "New")]
    with pytest.raises(NonUniqueKey):
        store.delete("city", "Lviv")
    stop()
    store.clear()
    assert store.rows().count() == 0 and seen == ["remove", "add", "update"]


def test_swap_pop_model():
    rng = random.Random(5)
    for _ in range(500):
        n = rng.randint(1, 9)
        wanted = [rng.randrange(n) for _ in range(rng.randint(0, n + 2))]
        rows = list(range(n))
        for w in wanted:
            if w in rows:
                at = rows.index(w)
                rows[at] = rows[-1]
                rows.pop()
        removed, moved = swap_pop(wanted, n)
        left = {moved.get(r, r): r for r in range(n) if r not in removed}
        assert [left[k] for k in range(len(left))] == rows


def test_facade(users):
    f = Facade(users, keys=["id"], search={"fields": ["name", "city"], "silent": True}, filter_by_previous_result=True)
    assert set(ids(f.search("v"))) == {1, 2, 3, 5}
    assert ids(f.filter([{"field": "city", "values": ["Lviv"]}])) == [2, 5]
    assert ids(f.sort([{"field": "age", "direction": "desc"}])) == [5, 2]
    f.add([{"id": 10, "name": "Vira", "city": "Kyiv", "age": 19}])
    assert ids(f.sort([{"field": "age"}])) == [10, 4, 1, 2, 3, 5]
    chained = f.search("v").filter([{"field": "city", "values": ["Kyiv"]}]).sort([{"field": "age"}])
    assert ids(chained) == [10, 1, 3]
    with pytest.raises(BadOption):
        Facade(users, keys=["id"], filter={"filter_by_previous_result": True})
    with pytest.raises(MissingEngine):
        Facade(users, keys=["id"], engines=[SortEngine]).search("v")


def test_repeated_pipeline_with_wider_values(spark):
    rows = [(9, "332 A", "Kyiv", 22), (10, "332 B", "Miami", 22), (11, "332 C", "Miami", 22), (12, "332 D", "Miami", 22), (13, "332 E", "Miami", 26)]
    f = Facade(spark.createDataFrame(rows, SCHEMA), keys=["id"], search={"fields": ["name"], "silent": True}, filter_by_previous_result=True)
    run = lambda *ages: ids(f.search("332").filter([{"field": "city", "values": ["Miami"]}, {"field": "age", "values": list(ages)}]).sort([{"field": "age"}]))
    assert run(22) == [10, 11, 12]
    assert run(22, 26) == []
