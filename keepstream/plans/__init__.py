"""Query plans over the tables of a data folder."""
