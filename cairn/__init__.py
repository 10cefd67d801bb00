"""cairn: auditable change-data-capture warehousing on PySpark."""
