import os
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
