"""Reading and writing: rosters, inventories, markup files and stage tables."""
