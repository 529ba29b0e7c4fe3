"""Movie-to-neuron-table analytics on Spark: DataFrame plans first, numpy kernels where arrays need them."""
