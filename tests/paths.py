"""Where the tables of the tests lie."""

import os

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
