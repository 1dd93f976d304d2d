"""Queries over the driver's tables, one for each operator of the survey, with the SQL that checks them."""
