"""The entry module without the training-data subpackage's packages."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_loads_where_a_third_party_package_is_missing():
    code = "import sys; sys.modules['ahocorasick'] = None; sys.modules['xxhash'] = None; import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 90 and not [n for n in q if n.startswith('op')], q; assert set(s) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)
