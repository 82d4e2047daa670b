"""Published results of a ten-row run: predictions, two labels, two correlations."""

# As they were published.
PREDICTIONS = ["0.991 ", "0.991 ", "0.991 ", "0.991 ", "0.88 ", "0.599 ", "0.95 ", "0.81 ",
               "0.991 ", "0.81 "]
XCOMET = [0.991200029850006, 1.0, 1.0, 0.9336091876029968, 0.9433715343475342,
          0.3927235007286072, 0.955078899860382, 0.5681241750717163, 0.9141116738319396,
          0.6181948184967041]
METRICX = [0.13337478, 0.55981994, 0.086484045, 1.8030248, 1.4770529, 7.6035395, 1.642354,
           3.9644694, 1.8022931, 5.800519]
CORR_XCOMET = 0.7548398491282626
CORR_METRICX = 0.7395739969534467
