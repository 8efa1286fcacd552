"""Folders of the driver's tables (a module of its own: every test folder has a ``conftest``)."""

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
