"""Workers that do not see the repository get the package from the driver."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from stockroom.session import build_session, ship_package
spark = build_session("shipped", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
ship_package(spark)
sys.path.remove({root!r})
from stockroom.plans.ledger import post_ledger
opening = spark.createDataFrame([(1, 5)], "product_id long, opening_qty long")
moves = spark.createDataFrame([(1, 1, "out", 4, 1), (2, 1, "out", 4, 2), (3, 1, "in", 1, 3)],
                              "id long, product_id long, type string, qty int, created_at int")
posted, rejects = post_ledger(opening, moves)
print("RESULT", sorted((r.id, r.qty_after) for r in posted.collect()), [r.id for r in rejects.collect()])
"""


def test_another_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, env=environment, capture_output=True,
                          text=True, timeout=300)
    assert "RESULT [(1, 1), (3, 2)] [2]" in done.stdout, done.stderr[-2000:]
