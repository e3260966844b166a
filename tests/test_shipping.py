import os
import subprocess
import sys

from pyspark import cloudpickle

from factsheet.operators import cells
from factsheet.operators.search import _best_rows
from factsheet.sources import records
from factsheet.sources.documents import docx_text


def test_task_functions_carry_their_code(tmp_path):
    functions = [_best_rows(None, 2, ["i"], ["i"]), cells._join(4, 2, ["i"]), records._ends, records._cut, docx_text]
    (tmp_path / "f").write_bytes(cloudpickle.dumps(functions))
    code = "import sys; from pyspark import cloudpickle; cloudpickle.loads(open('f','rb').read()); assert 'factsheet' not in sys.modules"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
