"""Archive-layout analytics on Spark: can a collection of array files be read as one lazy datacube?"""
