"""Inputs: driver tables, the loan table (derived or stored), explicit schema and file I/O."""
