"""Where the tests read their tables."""

from __future__ import annotations

import os

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
