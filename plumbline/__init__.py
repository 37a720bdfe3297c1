"""plumbline: a typed relational and object query layer over PySpark DataFrames."""
