"""Python helpers run on executors that do not have the package."""

import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_workers_need_no_installation(tmp_path, sf_dir):
    script = tmp_path / "job.py"
    script.write_text(textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        import __spark_entry__ as driver
        from plyclock.session import local_session
        spark = local_session(2)
        for name in ("score_moves_fold", "fit_p_values"):
            assert driver.queries()[name](spark, {sf_dir!r}).count() > 0
    """))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    # A session of its own, hence a process of its own, started elsewhere.
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
