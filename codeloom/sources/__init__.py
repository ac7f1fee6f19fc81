"""Readers and writers of tables, workspaces, versions and event logs."""
