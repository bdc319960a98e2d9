"""Whole dumps: statements over lines and splits, several databases and tables, and what is not understood."""

import gzip
import random

import pytest

from tablehaul.operators.restore_whole import restore_whole, stage_whole
from tablehaul.sources.statements import MODES, Scanner, State, effect

FOREIGN = """-- Current Database: `a`
/* block
INSERT INTO t VALUES (9,'z'); */
CREATE TABLE t (id INT, -- the key
  `name` TEXT COMMENT 'x;y' /* more; */
);
INSERT INTO t VALUES (1,'x;y'), -- c; (7,'no')
 (2,"it's ""q"" \\" z");
/*!50000 INSERT INTO t VALUES (3,'e') */;
DELIMITER ;;
CREATE TRIGGER x BEFORE INSERT ON t FOR EACH ROW BEGIN SET @a=1; INSERT INTO t VALUES (8,'no'); END;;
DELIMITER ;
CREATE DATABASE IF NOT EXISTS `b`; USE `b`;
CREATE TABLE `t` (`id` INT, `name` TEXT, extra INT);
# INSERT INTO t VALUES (6,'no');
INSERT INTO `t` VALUES (4,'a
b\\\\
c',-5);INSERT IGNORE INTO t (`name`, id) VALUES ('--',5); SET @x=5-1--1;
INSERT INTO `a`.`t` VALUES (10,'far /* kept */')"""
ROWS_A = {(1, "x;y"), (2, 'it\'s "q" " z'), (3, "e"), (10, "far /* kept */")}
ROWS_B = {(4, "a\nb\\\nc", -5), (5, "--", None)}


def put(work, name, text):
    path = f"{work}/{name}"
    with (gzip.open if name.endswith("gz") else open)(path, "wt", newline="") as out:
        out.write(text)
    return path


@pytest.mark.parametrize("name", ["x.sql", "x.sql.gz"])
def test_foreign_forms(spark, work, name):
    whole = restore_whole(spark, put(work, name, FOREIGN))
    assert set(whole.tables) == {("a", "t"), ("b", "t")}
    assert set(map(tuple, whole.read("a", "t").collect())) == ROWS_A
    assert set(map(tuple, whole.read("b", "t").collect())) == ROWS_B
    assert {r.statement: r.n for r in whole.passed().collect()} == {"CREATE TRIGGER": 1, "CREATE DATABASE": 1, "SET @X=5-1--1": 1}


def test_any_split_of_a_file_gives_the_same(spark, work):
    path = put(work, "x.sql", FOREIGN + ";\n")
    conf = {"spark.sql.files.maxPartitionBytes": "0", "spark.sql.files.minPartitionNum": "1", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for size in ("37", "90", "200"):
            for key, value in (conf | {"spark.sql.files.maxPartitionBytes": size}).items():
                spark.conf.set(key, value)
            whole = restore_whole(spark, path)
            assert set(map(tuple, whole.read("a", "t").collect())) == ROWS_A
            assert set(map(tuple, whole.read("b", "t").collect())) == ROWS_B
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def test_effects_compose():
    lines = FOREIGN.split("\n")
    random.seed(2)
    for _ in range(60):
        begin = State(random.choice(MODES), random.random() < 0.3, random.choice([";", ";;"]), random.random() < 0.5)
        cut = random.randint(0, len(lines))
        assert effect(lines[cut:], effect(lines[:cut], begin)) == effect(lines, begin)


def test_a_scanner_gives_statements_in_order():
    scanner = Scanner()
    got = [text for line in FOREIGN.split("\n") for text, _, _ in scanner.line(line)]
    assert [t.split()[0] for t in got] == ["CREATE", "INSERT", "INSERT", "CREATE", "CREATE", "CREATE", "INSERT", "INSERT", "SET"]


BASE = "CREATE TABLE t (id INT, name TEXT);\nINSERT INTO t VALUES (1,'a');\n"


@pytest.mark.parametrize(
    ("more", "problem"),
    [
        ("BEGIN; UPDATE t SET id = 2;", "changes data"),
        ("SET @x=1; DELETE FROM t;", "changes data"),
        ("ALTER TABLE t ADD COLUMN z INT;", "changes data"),
        ("DROP TABLE t;", "dropped after"),
        ("INSERT INTO u VALUES (1);", "does not create"),
        ("INSERT INTO t VALUES (1,'a') ON DUPLICATE KEY UPDATE id = 3;", "between the rows"),
        ("INSERT INTO t SELECT * FROM u;", "changes data"),
        ("INSERT INTO t VALUES (1,'a", "ends inside"),
        ("/* no end", "ends inside"),
        ("gibberish;", "changes data"),
    ],
)
def test_what_is_not_understood_fails(spark, work, more, problem):
    path = put(work, "x.sql", BASE + more)
    with pytest.raises(ValueError, match=problem):
        restore_whole(spark, path)
    assert problem in stage_whole(spark, path).problems().first().problem


@pytest.mark.parametrize(("row", "problem"), [("(1)", "number of fields"), ("('x','a')", "does not fit column id")])
def test_rows_that_do_not_fit_fail_when_read(spark, work, row, problem):
    whole = restore_whole(spark, put(work, "x.sql", BASE + f"INSERT INTO t VALUES {row};"))
    with pytest.raises(Exception, match=problem):
        whole.read(None, "t").collect()


def test_a_column_list_must_name_the_tables_columns(spark, work):
    for listed in ("(id, nme)", "(id, id)"):
        whole = restore_whole(spark, put(work, "x.sql", BASE + f"INSERT INTO t {listed} VALUES (1,'a');"))
        with pytest.raises(Exception, match="column list"):
            whole.read(None, "t").collect()


def test_jobs_do_not_grow_with_tables(spark, work):
    def jobs(n):
        path = put(work, f"{n}.sql", "".join(f"CREATE TABLE t{i} (id INT);\nINSERT INTO t{i} VALUES ({i});\n" for i in range(n)))
        spark.sparkContext.setJobGroup(f"whole {n}", "")
        restore_whole(spark, path)
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"whole {n}"))
        spark.sparkContext.setJobGroup("", "")
        return found

    assert jobs(2) == jobs(30)
