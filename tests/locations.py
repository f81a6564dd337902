"""Folders of the driver's tables; a named module, as every test folder has a conftest of its own."""

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
