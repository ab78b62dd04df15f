import shutil
import subprocess
import sys
from pathlib import Path

from voxledger.llm.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["row_id", "group_case"],
    "p2_found": ["source_table", "item_id"],
    "p3_found": ["name_a", "name_b"],
    "p4_found": ["case_id", "first_dialogue_no", "turn_in_row", "last_dialogue_no"],
    "p5_found": ["row_id_a", "row_id_b"],
    "p7_found": ["doc_id", "item_id"],
    "p8_found": ["doc_id"],
}


def test_columns(spark):
    every = queries()
    for name, columns in COLUMNS.items():
        df = every[name](spark, DATA)
        assert df.columns == columns and df.count() > 0, name
    assert set(oracle_sql()) <= set(every)


def test_rest_stands_alone():
    root = Path(__file__).parents[2]
    for path in (root / "voxledger").rglob("*.py"):
        if "llm" not in path.parts:
            assert "voxledger.llm" not in path.read_text() and "import llm" not in path.read_text(), path


def test_without_this_subpackage(tmp_path):
    root = Path(__file__).parents[2]
    shutil.copytree(root / "voxledger", tmp_path / "voxledger", ignore=lambda folder, names: [n for n in names if n in ("llm", "__pycache__")])
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    told = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('p1_') for q in e.queries()))"], cwd=tmp_path, check=True, capture_output=True, text=True).stdout.split()
    assert int(told[0]) > 50 and int(told[1]) > 45 and told[2] == "False"
