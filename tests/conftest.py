import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from anchorspan.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # Tables of a few rows: compiling their plans would take most of the time.
    quick = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.adaptive.enabled": "false", "spark.driver.extraJavaOptions": "-XX:TieredStopAtLevel=1 -XX:+UseSerialGC"}
    session = local_session(4, 2, **quick)
    yield session
    session.stop()
