"""Tables, graphs, versions and lineage as DataFrame transformations."""
