"""Query plans: parsing, checking, running, and a small front end for questions."""
