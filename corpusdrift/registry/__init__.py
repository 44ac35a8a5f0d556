"""Every operator as a named query over the generic tables, with SQL to compare it with."""
